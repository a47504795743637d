"""The audit log: entries, hash chains per file, keyed signatures, verification, queries and reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(original: Column) -> Column:
    return F.substring(F.sha2(original, 256), 1, 32)


def entries(found: DataFrame, order: list[str], file_col: str = "file") -> DataFrame:
    """file, seq (from 0), layer, type, original_hash, context; no pseudonym and no original is kept."""
    own = f"row_number() over (partition by {file_col} order by {', '.join(order)}) - 1"
    context = F.concat("type", F.lit("@"), F.col("offset").cast("string"), F.lit(":"), F.col("length").cast("string"))
    return found.select(file_col, F.expr(own).cast("long").alias("seq"), "layer", "type", short_hash(F.col("match")).alias("original_hash"), context.alias("context"))


def chain(lines: DataFrame, file_col: str = "file") -> DataFrame:
    """file, seq, base -> with prev_hash: the running hash of the bases before.

    A chain is sequential per file: files are dealt over tasks, and a task holds one line and one hash at a time.
    """
    kind = lines.schema[file_col].dataType.simpleString()
    names = ["file", "seq", "base", "prev_hash"]

    def run(batches):
        import pyarrow as pa

        last, held = None, ""
        for batch in batches:
            out = []
            for name, base in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != last:
                    last, held = name, ""
                out.append(held)
                held = hashlib.sha256((held + (base or "")).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    ordered = lines.select(F.col(file_col).alias("file"), F.col("seq").cast("long").alias("seq"), "base").repartition("file").sortWithinPartitions("file", "seq")
    return ordered.mapInArrow(run, f"file {kind}, seq long, base string, prev_hash string").withColumnRenamed("file", file_col)


def verify_chain(lines: DataFrame, file_col: str = "file", checkpoints: DataFrame | None = None) -> DataFrame:
    """file, lines, first_bad_seq (null: whole). Each stored hash must be that of the stored line before.

    Line numbers come from `line`, the order in the file. A line with seq 0 and an empty hash restarts the chain.
    checkpoints: file, last_seq, last_hash; where given, the last line must agree with it.
    """
    seen = lines.selectExpr("*", *(f"lag({c}) over (partition by {file_col} order by line) as before_{c}" for c in ("seq", "base", "prev_hash")))
    fresh = (F.col("seq") == 0) & (F.col("prev_hash") == "")
    follows = (F.col("seq") == F.col("before_seq") + 1) & (F.col("prev_hash") == F.sha2(F.concat("before_prev_hash", "before_base"), 256))
    wanted = F.when(F.col("before_seq").isNull(), F.lit(0)).otherwise(F.col("before_seq") + 1)
    bad = F.when(~(fresh | F.coalesce(follows, F.lit(False))), F.when(F.col("seq") != wanted, wanted).otherwise(F.col("seq")))
    marked = seen.withColumn("bad", bad)
    out = marked.groupBy(file_col).agg(F.count("*").alias("lines"), F.min(F.when(F.col("bad").isNotNull(), F.struct("line", "bad")))["bad"].cast("long").alias("first_bad_seq"), F.max(F.struct("line", "seq", F.sha2(F.concat("prev_hash", "base"), 256).alias("h"))).alias("end"))
    if checkpoints is not None:
        out = out.join(checkpoints, file_col, "left")
        off = (F.col("end.seq") != F.col("last_seq")) | (F.col("end.h") != F.col("last_hash"))
        out = out.withColumn("first_bad_seq", F.coalesce("first_bad_seq", F.when(F.coalesce(off, F.lit(False)), F.col("end.seq") + 1)))
    return out.select(file_col, "lines", "first_bad_seq")


def mac(line: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a line, hex, from the two padded keys."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, line.cast("binary")), 256))), 256)


def verify_macs(lines: DataFrame, sidecar: DataFrame, keys: dict[str, bytes], file_col: str = "file") -> DataFrame:
    """file, seq, reason: ok, missing, unknown-key, mismatch, orphan."""
    both = lines.select(file_col, "seq", "base").join(sidecar.select(file_col, "seq", "kid", F.col("mac").alias("given")), [file_col, "seq"], "full")
    expected = F.lit(None).cast("string")
    for kid, key in keys.items():
        expected = F.when(F.col("kid") == kid, mac(F.col("base"), key)).otherwise(expected)
    reason = F.when(F.col("base").isNull(), "orphan").when(F.col("given").isNull(), "missing").when(~F.col("kid").isin(*keys), "unknown-key").when(expected != F.col("given"), "mismatch").otherwise("ok")
    return both.select(file_col, "seq", reason.alias("reason"))


# Why a file fails.
REASONS = ["read-error", "checkpoint-parse", "chain-break", "sidecar-missing", "sidecar-without-key", "sidecar-parse", "sidecar-kid-mismatch", "sidecar-kid-revoked", "sidecar-mac-mismatch", "missing-seq"]


def verify_files(lines: DataFrame, checkpoints: DataFrame, sidecar: DataFrame, keys: dict[str, bytes] | None = None, strict: bool = False, default_kid: str = "default", unreadable: DataFrame | None = None) -> DataFrame:
    """file, status (ok, tamper, missing-checkpoint), bad_seq (-1: no line's), reason: the first that holds, in order.

    lines: file, line (place in the file), raw, seq, base, prev_hash. checkpoints: file, raw (JSON lastSeq, lastHash).
    sidecar: file, line, raw (JSON seq, mac, kid). keys: by kid; None: no keyring. unreadable: file.
    Everything is grouped by file, and line by line joined by (file, seq).
    """
    file = "file"
    given = checkpoints.select(file, F.from_json("raw", "lastSeq bigint, lastHash string").alias("c"))
    given = given.select(file, F.lit(True).alias("has_ckpt"), F.col("c.lastSeq").alias("last_seq"), F.col("c.lastHash").alias("last_hash"))
    given = given.withColumn("ckpt_ok", F.coalesce((F.col("last_seq") >= 0) & F.col("last_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))
    chained = verify_chain(lines, file, given.where("ckpt_ok").select(file, "last_seq", "last_hash"))
    out = lines.select(file).distinct().join(given.select(file, "has_ckpt", "ckpt_ok"), file, "left").join(chained.select(file, "first_bad_seq"), file, "left")
    side = sidecar.select(file, "line", F.from_json("raw", "seq bigint, mac string, kid string").alias("s"), F.get_json_object("raw", "$.kid").isNotNull().alias("has_kid"))
    side = side.select(file, "line", "s.seq", "s.mac", "has_kid", F.when(F.col("has_kid"), F.col("s.kid")).otherwise(F.lit(default_kid)).alias("kid"))
    label = F.when(F.col("has_kid"), F.concat(F.lit("k:"), "kid")).otherwise("-")
    kids = sorted(keys) if keys is not None else []
    first = lambda cond, what: F.min(F.when(cond, F.struct("line", what)))
    side = side.withColumn("label", label).withColumn("head", F.expr(f"first_value(label) over (partition by {file} order by line)"))
    per_side = side.groupBy(file).agg(
        F.lit(True).alias("has_side"),
        F.min(F.when(F.col("seq").isNull() | F.col("mac").isNull(), F.col("line"))).alias("parse_line"),
        first((F.col("label") != F.col("head")) | (F.col("kid") == ""), "seq").alias("mixed"),
        first(~F.col("kid").isin(kids or [""]), "seq").alias("revoked"),
    )
    macs = side.where("seq is not null").groupBy(file, "seq").agg(F.max(F.struct("line", "mac", "kid")).alias("m")).select(file, "seq", F.col("m.mac").alias("given"), F.col("m.kid").alias("kid"))
    expected = F.lit(None).cast("string")
    for kid in kids:
        expected = F.when(F.col("kid") == kid, mac(F.col("raw"), keys[kid])).otherwise(expected)
    checked = lines.select(file, "line", "seq", "raw").join(macs, [file, "seq"], "left").withColumn("wrong", F.coalesce(expected != F.col("given"), F.lit(True)))
    per_line = checked.groupBy(file).agg(F.min(F.when(F.col("seq").isNull(), F.col("line"))).alias("no_seq"), F.min(F.when(F.col("seq").isNotNull() & F.col("wrong"), F.struct("line", "seq"))).alias("bad_mac"))
    out = out.join(per_side, file, "left").join(per_line, file, "left")
    ring = keys is not None
    has_side, has_ckpt = F.coalesce("has_side", F.lit(False)), F.coalesce("has_ckpt", F.lit(False))
    side_faults = [
        (F.col("parse_line"), "sidecar-parse", F.lit(-1)),
        (F.col("mixed.line"), "sidecar-kid-mismatch", F.col("mixed.seq")),
        (F.col("revoked.line"), "sidecar-kid-revoked", F.col("revoked.seq")),
    ]
    least = F.least(*[c for c, _, _ in side_faults])
    faults = [(has_ckpt & ~F.coalesce("ckpt_ok", F.lit(False)), "checkpoint-parse", F.lit(-1))]
    faults += [(F.col("first_bad_seq").isNotNull(), "chain-break", F.col("first_bad_seq"))]
    faults += [(has_side & F.lit(not ring), "sidecar-without-key", F.lit(-1)), (~has_side & F.lit(ring), "sidecar-missing", F.lit(-1))]
    faults += [(F.lit(ring) & c.isNotNull() & (c == least), name, seq) for c, name, seq in side_faults]
    faults += [(F.lit(ring) & F.col("no_seq").isNotNull() & (F.col("bad_mac").isNull() | (F.col("no_seq") < F.col("bad_mac.line"))), "missing-seq", F.lit(-1))]
    faults += [(F.lit(ring) & F.col("bad_mac").isNotNull(), "sidecar-mac-mismatch", F.col("bad_mac.seq"))]
    reason, seq = F.lit(None).cast("string"), F.lit(None).cast("long")
    for cond, name, at in reversed(faults):
        reason, seq = F.when(cond, name).otherwise(reason), F.when(cond, at.cast("long")).otherwise(seq)
    if strict:
        bare = ~has_ckpt
        status = F.when(bare, "missing-checkpoint").when(reason.isNotNull(), "tamper").otherwise("ok")
        out = out.select(file, status.alias("status"), F.when(~bare, seq).alias("bad_seq"), F.when(~bare, reason).alias("reason"))
    else:
        out = out.select(file, F.when(reason.isNotNull(), "tamper").otherwise("ok").alias("status"), seq.alias("bad_seq"), reason.alias("reason"))
    if unreadable is not None:
        out = out.unionByName(unreadable.select(file, F.lit("tamper").alias("status"), F.lit(-1).cast("long").alias("bad_seq"), F.lit("read-error").alias("reason")))
    return out


def exit_code(results: DataFrame) -> int:
    """0: all files are whole; 2: one is tampered with; 3: none is, but one lacks its checkpoint."""
    found = {r.status for r in results.select("status").distinct().limit(3).collect()}
    return 2 if "tamper" in found else 3 if "missing-checkpoint" in found else 0


def gauges(results: DataFrame) -> DataFrame:
    """file, chain_broken, hmac_failed (0 or 1 each), and a row with a null file that has the totals."""
    flags = results.select("file", F.coalesce(F.col("reason") == "chain-break", F.lit(False)).cast("long").alias("chain_broken"), F.coalesce(F.col("reason").startswith("sidecar-") | (F.col("reason") == "missing-seq"), F.lit(False)).cast("long").alias("hmac_failed"))
    totals = flags.agg(F.sum("chain_broken").alias("chain_broken"), F.sum("hmac_failed").alias("hmac_failed"))
    return flags.unionByName(totals.select(F.lit(None).alias("file"), "chain_broken", "hmac_failed"))


def checkpoint_mac(last_seq: Column, last_hash: Column, file: Column, key: bytes) -> Column:
    """Version 2 of a checkpoint's signature: it covers the number, the hash and the file that they belong to."""
    return mac(F.concat_ws("|", F.lit("v2"), last_seq.cast("string"), last_hash, file.cast("string")), key)


def seed_state(lines: DataFrame, checkpoints: DataFrame, marks: DataFrame, key: bytes, file_col: str = "file") -> DataFrame:
    """file, state: whether a writer may go on from the end of a file. The first that holds:
    unsigned (the checkpoint's mac is wrong), rolled-back (behind the highest seq ever seen), truncated (the file ends
    before its checkpoint), replayed (another line stands at the checkpoint's place), ok, fresh (no line, no checkpoint).

    lines: file, line, seq, base, prev_hash. checkpoints: file, last_seq, last_hash, mac. marks: file, max_seq.
    """
    ends = lines.groupBy(file_col).agg(F.max("seq").alias("end_seq"))
    at = lines.join(checkpoints.select(file_col, "last_seq"), file_col).where("seq = last_seq").select(file_col, F.sha2(F.concat("prev_hash", "base"), 256).alias("hash_there"))
    whole = checkpoints.withColumn("signed", F.col("mac") == checkpoint_mac(F.col("last_seq"), F.col("last_hash"), F.col(file_col), key))
    out = whole.join(ends, file_col, "full").join(marks, file_col, "full").join(at, file_col, "left")
    state = F.when(F.col("end_seq").isNull() & F.col("last_seq").isNull() & F.col("max_seq").isNull(), "fresh").when(~F.coalesce("signed", F.lit(True)), "unsigned")
    state = state.when(F.coalesce("last_seq", "end_seq", F.lit(-1)) < F.coalesce("max_seq", F.lit(-1)), "rolled-back")
    state = state.when(F.coalesce("end_seq", F.lit(-1)) < F.coalesce("last_seq", F.lit(-1)), "truncated")
    state = state.when(F.col("last_seq").isNotNull() & F.coalesce(F.col("hash_there") != F.col("last_hash"), F.lit(True)), "replayed").otherwise("ok")
    return out.select(file_col, state.alias("state"))


def rehydrations(restored: DataFrame, order: list[str], file_col: str = "file") -> DataFrame:
    """Log entries of restored originals: layer `rehydration`, the type of the original, its short hash; no original."""
    own = f"row_number() over (partition by {file_col} order by {', '.join(order)}) - 1"
    return restored.select(file_col, F.expr(own).cast("long").alias("seq"), F.lit("rehydration").alias("layer"), "type", short_hash(F.col("original")).alias("original_hash"), F.concat(F.lit("rehydrated:"), F.length("pseudonym").cast("string")).alias("context"))


def pending_report(log: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """bucket, original_hash, file, seq, type. Buckets: pending (never rehydrated), sentinel-only (one-way by design);
    of files that failed the check only their number of entries, as bucket tamper-impacted with the number as seq.

    log: file, seq, ts, layer, type, original_hash, sentinel; tampered: file.
    """
    good = log.join(tampered.select("file").distinct(), "file", "left_anti") if tampered is not None else log
    sent = good.where("layer != 'rehydration'").groupBy("original_hash").agg(F.min(F.struct("ts", "file", "seq", "type", "sentinel")).alias("f"))
    open_ = sent.join(good.where("layer = 'rehydration'").select("original_hash").distinct(), "original_hash", "left_anti")
    out = open_.select(F.when(F.col("f.sentinel"), "sentinel-only").otherwise("pending").alias("bucket"), "original_hash", "f.file", "f.seq", "f.type")
    if tampered is None:
        return out
    bad = log.where("layer != 'rehydration'").join(tampered.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.count("*").alias("seq"))
    return out.unionByName(bad.select(F.lit("tamper-impacted").alias("bucket"), F.lit(None).cast("string").alias("original_hash"), "file", "seq", F.lit(None).cast("string").alias("type")))


def append(log: DataFrame, folder: str, on_failure: str = "permit", **options) -> bool:
    """write_log; a failure stops the caller (`block`) or is told and passed over (`permit`)."""
    import warnings

    try:
        write_log(log, folder, **options)
        return True
    except Exception as e:
        if on_failure == "block":
            raise
        warnings.warn(f"the audit log was not written: {e}", stacklevel=2)
        return False


def last_lines(lines: DataFrame, file_col: str = "file") -> DataFrame:
    """file, state (empty, ok, corrupt), seq: what the last line of each file says. lines: file, line, value."""
    last = lines.where(F.trim("value") != "").groupBy(file_col).agg(F.max(F.struct("line", "value"))["value"].alias("value"))
    seq = F.get_json_object("value", "$.seq").cast("long")
    every = lines.select(file_col).distinct().join(last, file_col, "left")
    return every.select(file_col, F.when(F.col("value").isNull(), "empty").when(seq.isNull(), "corrupt").otherwise("ok").alias("state"), seq.alias("seq"))


def export(log: DataFrame, path: str, start=None, end=None) -> None:
    """The entries of a time range as one JSON document per line, in order of time, in one file."""
    query(log, start, end).coalesce(1).sortWithinPartitions("ts").write.mode("overwrite").json(path)


def query(log: DataFrame, start=None, end=None, layer: str | None = None, kind: str | None = None, time_col: str = "ts") -> DataFrame:
    """Entries in a time range (both ends included), of a layer, of a type; what is None does not filter."""
    for cond in ((F.col(time_col) >= F.lit(start)) if start is not None else None, (F.col(time_col) <= F.lit(end)) if end is not None else None, (F.col("layer") == layer) if layer else None, (F.col("type") == kind) if kind else None):
        log = log if cond is None else log.where(cond)
    return log


def tail(log: DataFrame, n: int = 20, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last n entries, oldest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def pending(anonymised: DataFrame, rehydrated: DataFrame) -> DataFrame:
    """First entry of each hash that was never rehydrated."""
    first = anonymised.groupBy("original_hash").agg(F.min(F.struct("file", "seq", "type")).alias("f"))
    open_ = first.join(rehydrated.select("original_hash").distinct(), "original_hash", "left_anti")
    return open_.select("original_hash", "f.file", "f.seq", "f.type")


def high_water(checks: DataFrame, marks: DataFrame, file_col: str = "file") -> DataFrame:
    """Files whose checkpoint is behind the highest seq ever seen: rolled back."""
    return checks.join(marks, file_col).where("last_seq < max_seq").select(file_col, "last_seq", "max_seq")


def write_log(log: DataFrame, folder: str, rows_per_file: int = 50_000) -> None:
    """Append as JSON lines, a folder per day, files of bounded length."""
    log.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").option("maxRecordsPerFile", rows_per_file).json(folder)
