"""Centroid clustering by plain Lloyd rounds.

The centroids, a bounded table, are broadcast; each task takes its vectors by mapInPandas, computes for each
centroid the squared differences of integers in NumPy, and argmin takes the lowest of equally near ones.
A task adds up the vectors of each cluster as integers over its whole partition and gives one row for each component
of each centroid that it met; groupBy merges the tasks' sums, and the driver divides clusters x components numbers.
The last assignment is written to the shared folder before it is summed and read again.

Defined results: rows whose vector is null, of another length than `dim`, or has null or non-finite components have no
row in the result; rows without id are assigned but start no centroid; repeated rows are vectors of their own and
may start equal centroids, of which the lower takes all; equal hashes are taken in the order of components; with fewer vectors
than centroids there are fewer centroids; integers are held to +-2**62 and distances and their sums, exact to any size, are
given within the range of a long; very long vectors are of another length; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.frames import pick
from docloom.llm.integers import finite, floor_of, floors, group_sums, largest, like, long_sum, to_long
from docloom.llm.scratch import Scratch

DIM, CLUSTERS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
#: Vectors whose distances to all centroids are held at once.
ROWS = 4096


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (n, k), by differences of integers."""
    a, b = like(4 * x.shape[1] * max(1, largest(x), largest(centroids)) ** 2, x, centroids)
    out = np.empty((len(a), len(b)), a.dtype)
    for j, c in enumerate(b):
        d = a - c
        out[:, j] = (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)
    return out


def _assigned(pdf: pd.DataFrame, centroids: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: rows, integers, nearest centroid, distance."""
    for at in range(0, len(pdf), ROWS):
        rows = np.arange(at, min(len(pdf), at + ROWS))
        x = floors(np.stack(pdf["vec"].iloc[at : at + ROWS].to_list()), scale)
        d = distances(x, centroids)
        near = d.argmin(axis=1)
        yield rows, x, near, d[np.arange(len(x)), near]


def _sums(shared, scale: int):
    """cluster, place (-1: count), sum: of all of a task's vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
        for pdf in frames:
            for _, x, near, _ in _assigned(pdf, centroids, scale):
                met, sums, n = group_sums(x, near)
                total[met] += sums.astype(object)
                count[met] += n.astype(object)
        met = np.flatnonzero(count > 0)
        if len(met):
            w = centroids.shape[1] + 1
            value = np.concatenate([count[met][:, None], total[met]], axis=1).ravel()
            yield pd.DataFrame({"cluster": np.repeat(met, w).astype(np.int32), "place": np.tile(np.arange(-1, w - 1), len(met)).astype(np.int32), "sum": [Decimal(int(v)) for v in value]})

    return run


def _labels(shared, scale: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        for pdf in frames:
            for rows, _, near, d in _assigned(pdf, centroids, scale):
                yield pd.DataFrame({"id": pdf["id"].iloc[rows].to_list(), "cluster": near.astype(np.int32), "distance": to_long(d)})

    return run


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = pick(vectors, vec_id=(vec_id, "bigint"), vec=(embedding, kind)).where((F.size("vec") == dim) & finite(F.col("vec")))
    print_ = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    # bounded by the number of clusters
    seeds = rows.where("vec_id IS NOT NULL").select(print_.alias("print"), "vec").orderBy("print", "vec").limit(clusters).collect()
    centroids = floors(np.array([r.vec for r in seeds] or [[0.0] * dim], np.float64), scale)
    vec = rows.select("vec")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        sums = vec.mapInPandas(_sums(shared, scale), "cluster int, place int, sum decimal(38,0)").groupBy("cluster", "place").agg(F.sum("sum").alias("sum"))
        got = {(r.cluster, r.place): int(r["sum"]) for r in sums.collect()}  # at most clusters x (dim + 1) rows
        new = [[got[j, i] // got[j, -1] for i in range(dim)] if (j, -1) in got else c for j, c in enumerate(centroids.tolist())]
        centroids = np.array(new, np.int64)
    shared = spark.sparkContext.broadcast(centroids)
    # ids travel as text: pandas would turn longs beside nulls into doubles
    found = rows.select(F.col("vec_id").cast("string").alias("id"), "vec").mapInPandas(_labels(shared, scale), "id string, cluster int, distance bigint")
    found = scratch.table("assigned", found.select(F.col("id").cast("bigint").alias("vec_id"), "cluster", "distance"))
    own = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(long_sum(F.col("distance")).alias("inertia")).collect()}  # a row for each cluster
    total = min(sum(own.values()), (1 << 63) - 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame([(j, own.get(j, 0), total, h) for j, h in enumerate(digest)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), embedding) - 1 AS e, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY e < {CLUSTERS})",
    ]
    near = """a{r} AS MATERIALIZED (SELECT rid, m.e AS e, m.d AS d FROM (SELECT rid, min({{'d': list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'e': e}}) AS m FROM v JOIN b{r} ON true GROUP BY rid))"""
    for r in range(ROUNDS):
        steps += [
            near.format(r=r),
            f"s{r} AS (SELECT e, i, CAST(sum(t) AS BIGINT) AS s, count(*) AS m FROM (SELECT e, unnest(x) AS t, unnest(range({DIM})) AS i FROM a{r} JOIN v USING (rid)) GROUP BY e, i)",
            f"b{r + 1} AS MATERIALIZED (SELECT b.e AS e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{r} GROUP BY e) m USING (e))",
        ]
    return "WITH " + ",\n".join([*steps, near.format(r=ROUNDS)]) + f"""
SELECT vec_id, CAST(a.e AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.e) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN v USING (rid) JOIN b{ROUNDS} b ON a.e = b.e"""


SQL = _sql()


def brute_force(rows: list[tuple], clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> list[tuple]:
    """The result's rows in plain Python's integers, for tests."""
    import math

    kept = [(i, [floor_of(c, scale) for c in v], [float(c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v, r) for r, (i, _, v) in enumerate(kept) if i is not None)
    centroids = [kept[r][1] for *_, r in order[:clusters]] or [[0] * dim]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x, _ in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x, _), (_, e) in zip(kept, got, strict=True) if e == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    own = {j: sum(d for d, e in got if e == j) for j in range(len(centroids))}
    return [(i, e, d, own[e], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[e])).encode()).hexdigest()) for (i, *_), (d, e) in zip(kept, got, strict=True)]
