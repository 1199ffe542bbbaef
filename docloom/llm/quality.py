"""Quality scores: a Gaussian kernel by random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes some twenty statistics (lengths, classes of characters, repetition, shape
of words and lines). They are standardised by mean and deviation over all documents. Cosines of
random projections approximate a Gaussian kernel on them; each partition sums the products of its
labelled rows' features, and the sums, of a size that does not depend on the data, give the ridge
weights. Raw scores of labelled rows that the fit has not seen are counted in fine bins, and the
pool-adjacent-violators algorithm turns the bins into a non-decreasing probability.

Only labels outside the held-out fold are learned from; labels, language, source and id are never
inputs of a score. Defined results: null texts count as empty; rows with a null id belong to the
fold of the empty text and have no label; several labels of one id each count; with no labels at
all every score is 0.5; equal statistics have equal scores; a very long text is read whole, alone in its slice; repeated rows give one row each; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.frames import map_texts, pick
from docloom.llm.scratch import Scratch
from docloom.llm.words import Words, gram_hash

#: Random features, width of the kernel in standard deviations, ridge penalty, bins of the calibration, threshold.
RANDOM, WIDTH, RIDGE, BINS, THRESHOLD = 192, 4.0, 1e-3, 1000, 0.3
#: Folds by crc32(id): 0 is held out, 4 calibrates, the others fit the weights.
FOLDS, HELD, CALIBRATE = 5, 0, 4
#: Levels of the tree that adds the partitions' sums, and sums added in one task.
LEVELS, FAN = 3, 64

NAMES = ["log_bytes", "log_words", "word_len", "long_words", "short_words", "upper", "digit", "space", "high", "comma_dot", "symbol", "bar", "odd_marks", "log_lines", "line_words", "distinct", "top_word", "same_next", "repeat_2", "repeat_4", "ends_dot", "initial_upper"]


def statistics(col: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    w = Words(col, "spaced")
    n = len(col)
    off, counts = w.offsets, w.counts()
    raw = _raw(col)
    size = np.diff(off)
    per_byte = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[off[1:]] - c[off[:-1]]) / per_byte

    def mean(values: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return (c[w.bounds[1:]] - c[w.bounds[:-1]]) / np.maximum(counts, 1)

    is_ = lambda chars: np.isin(raw, np.frombuffer(chars.encode(), np.uint8))
    length = (w.end - w.start).astype(np.float64)
    upper = (raw >= 65) & (raw <= 90)
    lines = share(raw == 10) * per_byte + (size > 0)
    doc = np.repeat(np.arange(n), counts)

    def repeated(k: int) -> np.ndarray:
        """Share of k-word runs that stand more than once in their text."""
        g = gram_hash(w.hash, k)
        d = doc[: len(g)]
        inside = d == doc[k - 1 : k - 1 + len(g)] if len(g) else np.zeros(0, bool)
        g, d = g[inside], d[inside]
        at = np.lexsort((g, d))
        new = np.concatenate(([True], (g[at][1:] != g[at][:-1]) | (d[at][1:] != d[at][:-1]))) if len(g) else np.zeros(0, bool)
        distinct = np.bincount(d[at][new], minlength=n)
        return 1 - distinct / np.maximum(np.bincount(d, minlength=n), 1)

    at = np.lexsort((w.hash, doc))
    h, d = w.hash[at], doc[at]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate((first, [len(h)])))
    top = np.zeros(n)
    np.maximum.at(top, d[first], runs)
    same = np.zeros(len(doc))
    if len(doc) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    some = np.maximum(counts, 1)
    out = [
        np.log1p(size), np.log1p(counts), mean(length), mean(length > 12), mean(length <= 3), share(upper), share((raw >= 48) & (raw <= 57)), share((raw == 32) | (raw == 10)), share(raw >= 128), share(is_(",.")),
        share(is_("#$%&*@^~<>{}[]\\=+_")), share(raw == ord("|")), share(is_("!?;:")), np.log1p(lines), counts / np.maximum(lines, 1),
        np.bincount(d[first], minlength=n) / some, top / some, mean(same), repeated(2), repeated(4), mean(w.data[w.end - 1] == ord(".")) if len(doc) else np.zeros(n), mean(upper[w.start]) if len(doc) else np.zeros(n),
    ]
    return np.stack(out, axis=1).astype(np.float64)


def _raw(col: pa.Array) -> np.ndarray:
    from docloom.llm.words import string_bytes

    return string_bytes(col)[0]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = statistics(batch.column(1))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(NAMES)))], names=["doc_id", *NAMES])


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    planes: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.concatenate((np.cos(z @ self.planes + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        r = self.raw(x)
        return np.clip(r if self.knots is None else np.interp(r, self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and non-decreasing values from bins in rising order of x, by pooling adjacent violators."""
    pools: list[list[float]] = []  # ones, total, sum of x weighted
    for c, t, y in zip(x, total, ones, strict=True):
        pools.append([float(y), float(t), float(c) * float(t)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y1, t1, c1 = pools.pop()
            pools[-1] = [pools[-1][0] + y1, pools[-1][1] + t1, pools[-1][2] + c1]
    return np.array([c / t for _, t, c in pools]), np.array([y / t for y, t, _ in pools])


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.array(batch.column(batch.schema.get_field_index(c)), np.float64) for c in NAMES], axis=1)


def fit(stats: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """stats: doc_id and NAMES over all documents; labels: doc_id, quality."""
    spark = stats.sparkSession
    row = stats.agg(*(F.avg(c).alias(f"m_{c}") for c in NAMES), *(F.stddev_pop(c).alias(f"s_{c}") for c in NAMES)).first()
    rng = np.random.default_rng(seed)
    scale = np.array([row[f"s_{c}"] or 0.0 for c in NAMES])
    model = Model(np.array([row[f"m_{c}"] or 0.0 for c in NAMES]), np.where(scale > 1e-12, scale, 1.0), rng.standard_normal((len(NAMES), RANDOM)) / WIDTH, rng.uniform(0, 2 * np.pi, RANDOM))
    known = stats.join(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL"), "doc_id").withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD)
    shared, size = spark.sparkContext.broadcast(model), RANDOM + 1

    def sums(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = shared.value.features(_matrix(batch))
            a += z.T @ z
            b += z.T @ np.array(batch.column(batch.schema.get_field_index("quality")), np.float64)
        if a[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate((a.ravel(), b)).tobytes()], pa.binary())], names=["k", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size * size + size)
        for v in table["sums"]:
            total += np.frombuffer(v.as_py())
        return pa.table({"k": table["k"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    part = known.where(F.col("fold") != CALIBRATE).mapInArrow(sums, "k int, sums binary").withColumn("k", F.spark_partition_id())
    for level in range(LEVELS):  # a tree of sums, of FAN each: no task's share grows with the partitions
        part = part.withColumn("k", F.floor(F.col("k") / FAN).cast("int") if level < LEVELS - 1 else F.lit(0)).groupBy("k").applyInArrow(add, "k int, sums binary")
    rows = part.collect()  # one sum
    if not rows:
        return model
    total = np.frombuffer(rows[0].sums)
    a, b = total[: size * size].reshape(size, size), total[size * size :]
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / RANDOM * np.eye(size), b)
    fitted = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            r = fitted.value.raw(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((r + 0.5) / 2 * BINS).astype(np.int64)), pa.array(r), batch.column(batch.schema.get_field_index("quality")).cast(pa.int64())], names=["bin", "x", "y"])

    bins = known.where(F.col("fold") == CALIBRATE).mapInArrow(raw, "bin long, x double, y long").groupBy("bin").agg(F.count("*").alias("t"), F.sum("y").alias("y")).orderBy("bin").collect()  # at most BINS + 1 rows
    if bins:
        x = (np.array([r.bin for r in bins]) + 0.5) / BINS * 2 - 0.5
        model.knots, model.values = isotonic(x, np.array([r.t for r in bins]), np.array([r.y for r in bins]))
    return model


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    stats = scratch.table("statistics", map_texts(texts, "text", _measure, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES)))
    model = spark.sparkContext.broadcast(fit(stats, pick(labels, doc_id=("doc_id", "bigint"), quality=(quality, "int"))))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(_matrix(batch)))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
