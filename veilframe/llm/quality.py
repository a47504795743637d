"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of the whole text are standardised and mapped to n_features random cosines, which approximate a Gaussian
kernel. Every partition sums its part of the normal equations, per fold; the sums of these are all that the driver gets
(folds x n_features x n_features numbers, whatever the number of rows). Ridge weights of the other folds score every
labelled row; an isotonic fit on a histogram of these out-of-fold scores makes them probabilities. The final weights use
all folds.

Rows: null text is empty text; every text gets a score, empty ones too. Labels other than 0 and 1 are not learned.
Without any labelled row every score is 0.5. Repeated rows get equal scores, an empty table gives no rows, other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id, read, slices

_FOLDS = 4
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 other ASCII, 0 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_MARKS = [ord(c) for c in ".,!?|#$%&*-_/:;<>{}()[]=\"'"]
N_STATS = 15 + len(_MARKS)
_BLOCK = 1 << 16


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers of a text's bytes, words and lines."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    kinds = np.bincount(_CLASS, hist, 6) / max(n, 1)
    words = text.split()
    n_words = len(words)
    counted = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = sum(c for _, c in counted.most_common(3))
    small = sum(len(zlib.compress(text[i : i + _BLOCK], 1)) for i in range(0, n, _BLOCK))
    marked = len(re.findall(rb"[!#$%&*@|]{2,}(?=\s|$)", text))
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    per_word = max(n_words, 1)
    out = [np.log1p(n), np.log1p(n_words), *kinds, (n - kinds[4] * n) / per_word, len(counted) / per_word, top / per_word, small / max(n, 1), len(set(lines)) / max(len(lines), 1), marked / per_word, repeats / per_word]
    return [float(x) for x in out] + (np.sqrt(hist[_MARKS] / per_word)).tolist()


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for part in slices(batches, rows=512):
            stats = np.array([statistics(t or b"") for t in part.column(1).to_pylist()], np.float32).reshape(part.num_rows, N_STATS)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), N_STATS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "stats"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, stats array<float>")


class Model:
    """Standardisation, cosines, ridge weights and the isotonic steps."""

    def __init__(self, mean, scale, n_features: int, gamma: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, n_features))
        self.phases = rng.uniform(0, 2 * np.pi, n_features)
        self.weights: np.ndarray | None = None
        self.fold_weights: list[np.ndarray] = []
        self.steps: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats.astype(np.float64) - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.c_[np.ones(len(wave)), wave]

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(raw), 0.5)
        return np.interp((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (len(self.steps) - 1), np.arange(len(self.steps)), self.steps)


def isotonic(ones: np.ndarray, total: np.ndarray, prior: float) -> np.ndarray:
    """Pool adjacent violators over bins; every pool leans to the prior by one row. Empty bins take their neighbours'."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(total):
        pools.append([ones[i], total[i], i])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], a[2]]
    at, value, begin = [], [], -1
    full = np.flatnonzero(total)
    for one, n, last in pools:
        inside = full[(full > begin) & (full <= last)]
        at += [inside[0], inside[-1]]
        value += [(one + prior) / (n + 1)] * 2
        begin = last
    return np.maximum.accumulate(np.interp(np.arange(len(total)), at, value))


def fit(stats: DataFrame, labels: DataFrame, n_features: int = 256, gamma: float = 0.01, ridge: float = 1e-3, bins: int = 2001) -> Model:
    """stats: doc_id and statistics of the rows to learn from; labels: doc_id, label (0 or 1)."""
    spark = stats.sparkSession
    # Labels that repeat for an id are averaged to one; an id's rows all learn it.
    label = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    rows = Scratch(spark, "quality").table(stats.join(label, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(_FOLDS)).cast("int").alias("fold"), "label", "stats"), "learn")
    # Means by single sums of the array's elements: one row of 2 * N_STATS numbers.
    sums = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *(f.alias(f"{c}{i}") for i in range(N_STATS) for c, f in (("m", F.avg(F.get("stats", F.lit(i)))), ("s", F.stddev_pop(F.get("stats", F.lit(i))))))).first()
    if not sums.n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), n_features, gamma)
    mean = np.array([sums[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([max(sums[f"s{i}"], 1e-3) for i in range(N_STATS)])
    model = Model(mean, scale, n_features, gamma)
    size = n_features + 1

    def partial(batches):
        a, b = np.zeros((_FOLDS, size, size)), np.zeros((_FOLDS, size))
        for part in slices(batches, rows=4096):
            x = model.features(np.asarray(part.column(2).flatten()).reshape(-1, N_STATS))
            y, fold = np.asarray(part.column(1)), np.asarray(part.column(0))
            for f in range(_FOLDS):
                own = fold == f
                a[f] += x[own].T @ x[own]
                b[f] += y[own] @ x[own]
        block = [np.c_[a[f], b[f]][i : i + 32].tobytes() for f in range(_FOLDS) for i in range(0, size, 32)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(block)), pa.int32()), "sums": pa.array(block, pa.binary())})

    def add(key, batches):
        total = 0.0
        for batch in batches:
            for s in sorted(batch.column("sums").to_pylist()):  # sorted: the same order whatever the shuffle's
                total = total + np.frombuffer(s)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def summed(table_key, table):
        return pa.Table.from_batches(list(add(table_key, table.to_batches(max_chunksize=None))))

    parts = rows.mapInArrow(partial, "block int, sums binary").groupBy("block").applyInArrow(lambda key, t: summed(key, t.combine_chunks()), "block int, sums binary").collect()
    flat = np.concatenate([np.frombuffer(r.sums).reshape(-1, size + 1) for r in sorted(parts, key=lambda r: r.block)]).reshape(_FOLDS, size, size + 1)
    solve = lambda ab: np.linalg.solve(ab[:, :-1] + ridge * sums.n * np.eye(size) / size, ab[:, -1])
    model.weights = solve(flat.sum(0))
    model.fold_weights = [solve(flat.sum(0) - flat[f]) for f in range(_FOLDS)]

    def binned(batches):
        total, ones = np.zeros(bins), np.zeros(bins)
        for part in slices(batches, rows=4096):
            x = model.features(np.asarray(part.column(2).flatten()).reshape(-1, N_STATS))
            y, fold = np.asarray(part.column(1)), np.asarray(part.column(0))
            raw = np.einsum("ij,ij->i", x, np.array(model.fold_weights)[fold])
            at = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (bins - 1)).astype(int)
            total += np.bincount(at, minlength=bins)
            ones += np.bincount(at, y, bins)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(full.astype(np.int32)), "n": total[full], "ones": ones[full]})

    total, ones = np.zeros(bins), np.zeros(bins)
    for r in rows.mapInArrow(binned, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
        total[r.bin], ones[r.bin] = r.n, r.ones
    model.steps = isotonic(ones, total, sums.ones / sums.n)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    given = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = given.value
        for part in slices(batches, rows=4096):
            if m.weights is None:
                out = np.full(part.num_rows, 0.5)
            else:
                out = m.calibrated(m.features(np.asarray(part.column(1).flatten()).reshape(-1, N_STATS)) @ m.weights)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(out, 6))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark, "statistics").table(document_statistics(read(spark, sf_dir, "documents")), "stats")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    model = fit(stats.where(crc_of_id() % 5 != 0), labels.where(crc_of_id() % 5 != 0))
    out = score(stats, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
