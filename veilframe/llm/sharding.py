"""K-d tree partitioning into shards of near equal bytes, with DataFrame functions only.

The tree splits a node of n leaves at the weighted quantile that gives floor(n/2) leaves their share of the node's
bytes, along the metadata dimension in which the node is widest (ranges are relative to the whole table's). A row's place
on a dimension is its scaled value, with a hash of the row and one of its position in the table behind it, so equal
values and equal rows can be split too. The number of leaves is given, or follows from the target bytes. The quantile is found by
histograms of 4,096 bins that narrow to the bin with the target: per pass, one aggregation of all nodes and at most
bins x nodes rows to the driver, whatever the size of the table. Each level writes every row's node to a table of
metadata without texts.

Slots are counted in two levels: rows per (shard, sub) group of about rows_per_group rows, running totals of these
groups, and row numbers inside them; so no task sorts a whole shard.

Rows: null text counts no bytes; the size is at least 16. Null dimension values take the lowest place. Rows that are
equal in all of doc_id, size and text checksum are told apart by their position, so any number of them (a null id with a
null text, say) is dealt evenly; each gets a slot. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: Of a place: the scaled value, bits of the row's hash, bits of its position's.
_SCALE, _TIE, _POS = 1 << 20, 24, 18


def default_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Numeric metadata of documents; names are placed by a hash."""
    named = {"source": 1024, "lang": 64}
    dims = {"id": F.col("doc_id").cast("double"), "size": F.log2(F.col("size").cast("double"))}
    return dims | {c: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("double") for c, n in named.items() if c in docs.columns}


def _per_node(values: dict[int, str], node: str = "node", kind: str = "bigint") -> Column:
    whens = " ".join(f"when {n} then {v}" for n, v in values.items())
    return F.expr(f"cast(case {node} {whens} end as {kind})")


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, size: Column | None = None, dimensions: dict[str, Column] | None = None, bins: int = 4096, tolerance: float = 0.002, rows_per_group: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. tolerance: part of a shard's target that a cut may be off.

    With target_bytes, nodes are split until their leaves have at most that many bytes on average.
    """
    scratch = Scratch(docs.sparkSession, "kd")
    raw = F.col("text").cast("string").cast("binary")
    weight = size if size is not None else F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 16
    keep = [c for c in docs.columns if c not in ("size", "text_crc32")]
    sized = docs.select(*keep).withColumns({"size": weight, "text_crc32": F.crc32(F.coalesce(raw, F.lit(b"")))}).withColumn("doc_id", F.col("doc_id").cast("long"))
    dims = dimensions or default_dimensions(docs)
    meta = sized.select("doc_id", "size", "text_crc32", *(c.alias(f"v_{d}") for d, c in dims.items()))
    meta = scratch.table(meta.withColumn("row", F.monotonically_increasing_id()), "values")
    ranges = meta.agg(*(f(f"v_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if target_bytes:
        shards = max(1, -(-ranges["bytes"] // target_bytes))
    tie = F.expr(f"shiftleft(shiftrightunsigned(xxhash64(doc_id, size, text_crc32), {64 - _TIE}), {_POS}) + shiftrightunsigned(xxhash64(row), {64 - _POS})")

    def place(d: str) -> Column:
        lo, hi = ranges[f"lo_{d}"], ranges[f"hi_{d}"]
        if lo is None or hi <= lo:
            return tie
        scaled = F.least(F.floor((F.col(f"v_{d}") - lo) / F.lit(hi - lo) * _SCALE), F.lit(_SCALE - 1))
        return F.coalesce(scaled, F.lit(0)).cast("long") * (1 << (_TIE + _POS)) + tie

    meta = scratch.table(meta.select("doc_id", "size", "text_crc32", "row", *(place(d).alias(f"k_{d}") for d in dims)), "places")
    meta = meta.withColumn("node", F.lit(1))
    level = 0
    leaves = {1: (0, shards)}  # node: its first shard, its number of shards
    split: dict[int, tuple[str, int]] = {}

    while active := {n: v for n, v in leaves.items() if v[1] > 1}:
        at = meta.where(F.col("node").isin(list(active)))
        spans = {r.node: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), *(f(f"k_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        state = {}
        for n, (first, count) in list(active.items()):
            left = count // 2
            leaves[2 * n], leaves[2 * n + 1] = (first, left), (first + left, count - left)
            del leaves[n]
            r = spans.get(n)
            if r is None:
                split[n] = (next(iter(dims)), 0)
                continue
            d = max(dims, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])
            state[n] = {"d": d, "lo": r[f"lo_{d}"], "hi": r[f"hi_{d}"] + 1, "before": 0, "goal": r.w * left / count, "fine": tolerance * r.w / count}
        while state:
            width = {n: -(-(s["hi"] - s["lo"]) // bins) for n, s in state.items()}
            key = _per_node({n: f"k_{s['d']}" for n, s in state.items()})
            lo, hi, step = (_per_node({n: f"{v}L" for n, v in x.items()}) for x in ({n: s["lo"] for n, s in state.items()}, {n: s["hi"] for n, s in state.items()}, width))
            inside = at.where(F.col("node").isin(list(state))).select("node", "size", key.alias("k"), lo.alias("lo"), hi.alias("hi"), step.alias("step")).where("k >= lo and k < hi")
            found = inside.groupBy("node", F.expr("(k - lo) div step").alias("bin")).agg(F.sum("size").alias("w")).collect()
            by: dict[int, list[tuple[int, int]]] = {}
            for r in found:
                by.setdefault(r.node, []).append((r.bin, r.w))
            for n, s in list(state.items()):
                run = s["before"]
                for b, w in sorted(by[n]):
                    if run + w >= s["goal"]:
                        break
                    run += w
                low = s["lo"] + b * width[n]
                high = min(low + width[n], s["hi"])
                if width[n] == 1 or w <= s["fine"]:
                    split[n] = (s["d"], low if s["goal"] - run <= run + w - s["goal"] else high)
                    del state[n]
                else:
                    s |= {"lo": low, "hi": high, "before": run}
        sides = {n: f"if(k_{split[n][0]} < {split[n][1]}L, {2 * n}, {2 * n + 1})" for n in active}
        level += 1
        meta = scratch.table(meta.withColumn("node", F.coalesce(_per_node(sides, kind="int"), F.col("node"))), f"level{level}")
        scratch.drop("values" if level == 1 else "places" if level == 2 else f"level{level - 2}")
    placed = meta.withColumn("shard", _per_node({n: str(first) for n, (first, _) in leaves.items()}, kind="int"))
    groups = max(1, -(-ranges["n"] // (shards * rows_per_group)))
    placed = placed.select("doc_id", "size", "text_crc32", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("sub"))
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "sub", "sum(n) over (partition by shard order by sub) - n as before")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, sub order by doc_id, size, text_crc32, row) - 1 as own")
    return numbered.join(before, ["shard", "sub"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
