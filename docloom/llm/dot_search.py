"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A component's place is a term. A query is a sparse row of terms and integer weights; candidates are inverted
into postings, for each term the rows that hold it and their weights. A query takes one term after another
and scatters weight times posting into a dense array of scores, one for each candidate of the slice; its best
are selected by partition of that array and merged with those of the slices before. A task gives the best of
each query over all its candidates, once; a window merges tasks.

Queries come in packs of bounded size, numbered exactly; each pack is broadcast and meets all candidates in a
job of its own, whose result is written to the shared folder. Candidates are never shuffled.

Defined results: rows whose vector is null or has null or non-finite components, and rows without id, take no part;
components that a shorter vector lacks are zeros, so the empty vector scores 0; equal scores go to the smaller id; repeated rows
are queries and candidates of their own, of which a query leaves out itself only; a very long vector is
taken whole; integers are held to +-2**62 and scores to the range of a long before they are compared;
other columns are ignored, whatever their names; an empty table and one without queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.frames import pick
from docloom.llm.integers import LONG, finite, floor_of, largest, matrix, to_long
from docloom.llm.scratch import Scratch

K, EVERY, SCALE = 10, 100, 1024
#: Components of the queries of a pack, and candidates of a slice.
PACK, SLICE = 1 << 20, 8192

_FOUND = "q int, query_id bigint, copies int, vec_id bigint, score bigint, same boolean"


class Postings:
    """Of each term the rows that hold it with their weights; of a term that most rows hold all weights, zeros too, without rows."""

    def __init__(self, x: np.ndarray, kind: type):
        self.n, self.rows, self.weights = len(x), [], []
        for column in np.ascontiguousarray(x.T):
            at = np.flatnonzero(column)
            dense = 4 * len(at) > len(column)
            self.rows.append(None if dense else at)
            self.weights.append((column if dense else column[at]).astype(kind))

    def score(self, terms: np.ndarray, weights: np.ndarray, out: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Scores of all rows, term after term, in out; held is room of the same size."""
        out[:] = 0
        for t, w in zip(terms.tolist(), weights, strict=True):
            if t >= len(self.rows):
                break
            if self.rows[t] is None:
                np.multiply(self.weights[t], w, out=held)
                out += held
            else:
                out[self.rows[t]] += self.weights[t] * w  # a row stands once in a posting
        return out


def best(score: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id, in order."""
    at = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((~same[at], ids[at], ~score[at]))][:k]  # the complement turns the order round without overflow


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    bound = max(1, q.shape[1]) * max(1, largest(q)) * max(1, largest(x))
    return np.int32 if bound < 1 << 31 else np.int64 if bound <= LONG else object


def _search(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, q = shared.value
        by_id: dict[int, list[int]] = {}
        for i, v in enumerate(ids.tolist()):
            by_id.setdefault(v, []).append(i)
        sparse = [(t, q[i, t]) for i in range(len(q)) for t in [np.flatnonzero(q[i])]]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = [none] * len(q)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                cand, col = np.asarray(piece.column(0)), piece.column(1)
                x = matrix(col, max(1, int(np.diff(np.asarray(col.offsets)).max())), scale)
                kind = _kind(q, x)
                postings, room = Postings(x, kind), np.zeros((2, len(x)), kind)
                own: dict[int, list[int]] = {}
                for r in np.flatnonzero(np.isin(cand, ids)).tolist():
                    for i in by_id[int(cand[r])]:
                        w = min(q.shape[1], x.shape[1])
                        if (q[i, :w] == x[r, :w]).all() and not q[i, w:].any() and not x[r, w:].any():
                            own.setdefault(i, []).append(r)
                same = np.zeros(len(x), bool)
                for i, (terms, weights) in enumerate(sparse):
                    score = to_long(postings.score(terms, weights.astype(kind), room[0], room[1]))
                    same[own.get(i, [])] = True
                    s, v, m = held[i]
                    top = best(score, cand, same, k)
                    if len(s) < k or score[top[0]] >= s[-1]:
                        s, v, m = np.concatenate([s, score[top]]), np.concatenate([v, cand[top]]), np.concatenate([m, same[top]])
                        first = best(s, v, m, k)
                        held[i] = (s[first], v[first], m[first])
                    same[own.get(i, [])] = False
        n = [len(h[0]) for h in held]
        if sum(n):
            s, v, m = (np.concatenate([h[j] for h in held]) for j in range(3))
            i = np.repeat(np.arange(len(held)), n)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(ids[i]), pa.array(copies[i].astype(np.int32)), pa.array(v), pa.array(s), pa.array(m)], names=["q", "query_id", "copies", "vec_id", "score", "same"])

    return run


def _packed(queries: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The queries, each row once, with the number of its pack; and how many packs there are. Numbers come from exact counts of the written partitions."""
    at = queries.groupBy("vec_id", "vec").agg(F.count("*").alias("copies")).withColumn("at", F.monotonically_increasing_id())
    at = scratch.table("queries", at)
    part_of = F.shiftrightunsigned("at", 33)
    before, n = [], 0
    for r in at.groupBy(part_of.alias("pid")).count().orderBy("pid").collect():  # a row for each partition
        before.append((r.pid, n))
        n += r["count"]
    offsets = F.broadcast(queries.sparkSession.createDataFrame(before or [(0, 0)], "pid long, before long"))
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    return at.withColumn("pid", part_of).join(offsets, "pid").select("vec_id", "vec", "copies", F.floor(number / F.lit(most)).cast("int").alias("pack")), -(-n // most)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every` the k best other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "dot-search")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = pick(vectors, vec_id=(vec_id, "bigint"), vec=(embedding, kind)).where(F.col("vec_id").isNotNull() & finite(F.col("vec")))
    asked = rows.where(F.col("vec_id") % every == 0)
    longest = max(1, asked.agg(F.max(F.size("vec"))).first()[0] or 0)
    queries, packs = _packed(asked, max(1, pack // longest), scratch)
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for p in range(packs):
        mine = queries.where(F.col("pack") == p).toArrow()  # at most pack components
        q = matrix(mine["vec"].combine_chunks(), longest, scale)
        shared = spark.sparkContext.broadcast((np.asarray(mine["vec_id"]), np.asarray(mine["copies"]), q))
        found = rows.mapInArrow(_search(shared, k + 1, scale), _FOUND)
        place = found.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id", F.desc("same")))).where(F.col("place") <= k + 1)
        own = F.min(F.when(F.col("same"), F.col("place"))).over(W.partitionBy("q"))
        others = place.withColumn("own", own).where(F.col("own").isNull() | (F.col("place") != F.col("own")))
        ranked = others.withColumn("rank", F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).where(F.col("rank") <= k)
        each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        out = out.unionByName(scratch.table(f"top{p}", each.select("query_id", "rank", "vec_id", "score")))
    return out


SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT), 0) AS score
  FROM e q JOIN e c ON q.rid <> c.rid WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""


def brute_force(rows: list[tuple], k: int = K, every: int = EVERY, scale: int = SCALE) -> list[tuple]:
    """(query_id, rank, vec_id, score) in plain Python's integers, for tests."""
    import math

    ok = [(i, [floor_of(c, scale) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-max(-LONG - 1, min(LONG, sum(p * q for p, q in zip(x, y, strict=False)))), j) for b, (j, y) in enumerate(ok) if a != b)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out
