"""Inverted-file vector index: every stored vector in the cell of its nearest centroid, cells as partitions of a table.

Centroids are fitted on a bounded sample (SAMPLE rows by hash of the id; a parameter); every row is assigned,
and the table is written partitioned by cell, cells with many rows in several files. A search gives each query its nearest
cells, reads those partitions only, and scores their vectors exactly, in double precision. With all cells the
result is that of a scan. How many cells to probe is measured: tune() takes the least number whose recall against a
scan, over a bounded sample of queries, reaches a target, and stores it with the index.

Queries are taken in blocks of at most BLOCK and broadcast with their cells; those of another length than the index has, or with nulls, find nothing. Stored vectors are not shuffled by a search, and each task gives the k best of each query once. Vectors that are null, empty, or have null or non-finite components,
and rows without id, are not stored; zero vectors are, and have cosine 0. Vectors of another length than the first sampled
one are refused. Cosine, angular and Euclidean similarity only: the others do not follow cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import vector as vx
from docloom.operators.keyword import top_k
from docloom.operators.vectors import BLOCK, Nearest, blocks_of

#: Rows that centroids are fitted on, the most cells, rows of a file of a cell, and queries that tune() measures with.
SAMPLE, CELLS, FILE_ROWS, TUNED = 32_768, 4096, 1 << 20, 256
METRICS = ("cosine", "angular", "euclidean")
#: Columns of the table, and rows that are compared with all centroids at once.
PLACED, TILE = "vec_id long, vector array<double>, cell int", 2048


@dataclass(frozen=True)
class IvfIndex:
    """table: vec_id, vector, cell (partition). centroids: (cells, dim). probes: cells a query visits unless it says otherwise."""

    spark: SparkSession
    path: str
    metric: str
    centroids: np.ndarray
    probes: int
    table: DataFrame


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; their folders are listed here, once for an index, which takes a task for each cell."""
    return spark.read.schema(PLACED).parquet(f"{path}/cells")


def _usable(store: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return store.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))


def _direction(v: np.ndarray, metric: str) -> np.ndarray:
    """What is near by the metric is near in this space by Euclidean distance."""
    if metric == "euclidean":
        return v
    norm = np.linalg.norm(v, axis=1)[:, None]
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _far(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances but for a term that is the same for all centroids."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * (v @ centroids.T)


def _assign(shared, metric: str):
    """vec_id, vector, and the number of the nearest of the shared centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                cell = np.concatenate([_far(_direction(v[a : a + TILE], metric), shared.value).argmin(axis=1) for a in range(0, len(v), TILE)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    return run


def _fit(points: DataFrame, cells: int, rounds: int, seed: int, moved: float = 1e-4) -> np.ndarray:
    """Centroids by Lloyd's rounds over the sampled points (vec_id, vector), until none moves further than `moved`.

    They start as the first points by hash, equal ones once. In a round no more than a row for each centroid comes to the driver. MLlib's KMeans
    sends the distances of all pairs of centroids too, below 1,000 of them; its block solver fails where drawn points are equal.
    """
    sc, points = points.sparkSession.sparkContext, points.cache()  # as many rows as the sample has
    rows = points.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells).select("vector").toArrow()
    centroids = np.asarray(rows["vector"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    centroids = centroids[np.sort(np.unique(centroids, axis=0, return_index=True)[1])]
    for _ in range(rounds):
        shared = sc.broadcast(centroids)
        mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vector"))))
        means = points.mapInArrow(_assign(shared, "euclidean"), PLACED).groupBy("cell").agg(mean.alias("mean")).toArrow()
        new = centroids.copy()  # those without points stay
        new[np.asarray(means["cell"])] = np.asarray(means["mean"].combine_chunks().flatten()).reshape(means.num_rows, -1)
        step, centroids = np.linalg.norm(new - centroids, axis=1).max(), new
        shared.unpersist()
        if step <= moved:
            break
    points.unpersist()
    return centroids


def build(store: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> IvfIndex:
    """Fits, assigns and writes; cells defaults to twice the root of the number of rows, CELLS at most. Probes are a tenth of the cells until tune() says better."""
    if metric not in METRICS:
        raise ValueError(f"cells do not follow {metric}; one of {', '.join(METRICS)}")
    spark = store.sparkSession
    rows = _usable(store, vec_id, embedding)
    n = rows.count()
    of = 1 << 30
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)) < F.lit(int(of * sample / n)))
    cells = max(1, min(cells or 2 * int(np.sqrt(n)), CELLS, n or 1))
    norm = vx.normalize(F.col("vector")) if metric != "euclidean" else F.col("vector")
    dim, centroids = 0, np.zeros((0, 1))
    if n:
        dim = some.select(F.size("vector").alias("d")).first().d
        if rows.where(F.size("vector") != dim).limit(1).count():
            raise ValueError(f"vectors of another length than {dim}")
        some = some.withColumn("vector", norm)
        # in one order whatever the partitions, so that the same rows give the same cells
        centroids = _fit(some.orderBy("vec_id").coalesce(1) if n <= sample else some, cells, rounds, seed)
    shared = spark.sparkContext.broadcast(centroids)  # at most CELLS x dim

    # rebalanced by cell: small cells share tasks, and a cell of many rows is split over several
    placed = rows.mapInArrow(_assign(shared, metric), PLACED).hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/cells")
    if not n:
        rows.withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{path}/cells")
    made = IvfIndex(spark, path, metric, centroids, max(1, len(centroids) // 10), _listed(spark, path))
    _note(made)
    return made


def _note(index: IvfIndex) -> None:
    """The index's small facts, as one row beside its table."""
    row = [(index.metric, index.probes, index.centroids.shape[1], json.dumps(index.centroids.tolist()))]
    index.spark.createDataFrame(row, "metric string, probes int, dim int, centroids string").coalesce(1).write.mode("overwrite").json(f"{index.path}/facts")


def load(spark: SparkSession, path: str) -> IvfIndex:
    r = spark.read.schema("metric string, probes int, dim int, centroids string").json(f"{path}/facts").first()
    return IvfIndex(spark, path, r.metric, np.array(json.loads(r.centroids), np.float64).reshape(-1, r.dim), r.probes, _listed(spark, path))


def probed(index: IvfIndex, queries: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each query (n, probes), the nearest first, equal ones by number."""
    return np.argsort(_far(_direction(queries, index.metric), index.centroids), axis=1, kind="stable")[:, :probes]


def search(index: IvfIndex, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank, of queries (query_id, vector): the k best of the probed cells; of all with `exact`."""
    spark, cells = index.spark, len(index.centroids)
    probes = cells if exact else min(cells, probes or index.probes)
    # in single precision if they are stored so, as they go through the driver
    v = F.col("vector") if dict(queries.dtypes)["vector"] == "array<float>" else F.col("vector").cast("array<double>")
    q = queries.select("query_id", v.alias("vector")).where((F.size("vector") == index.centroids.shape[1]) & F.forall("vector", lambda x: x.isNotNull()))
    out = None
    for part in blocks_of(q) if cells else []:
        asked = part.toArrow()  # at most about BLOCK rows
        if not asked.num_rows:
            continue
        vectors = np.asarray(asked["vector"].combine_chunks().flatten(), np.float64).reshape(asked.num_rows, -1)
        near = probed(index, vectors, probes)
        wanted = np.unique(near)
        # partitions of other cells are not listed for reading
        table = index.table if len(wanted) == cells else index.table.where(F.col("cell").isin([int(c) for c in wanted]))
        found = table.mapInArrow(_visit(spark.sparkContext.broadcast((vectors, near)), k, index.metric), "q int, vec_id long, score double")
        named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(asked.num_rows, dtype=np.int32)), "query_id": asked["query_id"]}))
        found = found.join(F.broadcast(named), "q").select("query_id", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select("query_id").limit(0).withColumns({"vec_id": F.lit(0).cast("long"), "score": F.lit(0.0)})
    return top_k(out, k, tie="vec_id")


def _visit(shared, k: int, metric: str):
    """Of each query the k best of a task's rows, given once: slices of one cell meet the queries that probe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, near = shared.value
        ends = np.argsort(near, axis=None, kind="stable")
        cell_of, asked = near.ravel()[ends], ends // near.shape[1]
        best = Nearest(vectors, k, metric)
        for batch in batches:
            ids, col, cell = np.asarray(batch.column("vec_id")), batch.column("vector"), np.asarray(batch.column("cell"))
            v = np.asarray(col.flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, vectors.shape[1]))
            for c in np.unique(cell).tolist():
                who, mine = asked[np.searchsorted(cell_of, c) : np.searchsorted(cell_of, c, "right")], np.flatnonzero(cell == c)
                best.add(ids[mine], v[mine], who)
        yield from best.rows(np.arange(len(vectors)))

    return run


def recall(index: IvfIndex, queries: DataFrame, k: int = 10, probes: int | None = None, truth: DataFrame | None = None) -> float:
    """Share of the exact k best that a search with so many probes finds; truth, if given, is search(exact=True)."""
    want = (truth or search(index, queries, k, exact=True)).select("query_id", "vec_id")
    got = search(index, queries, k, probes).select("query_id", "vec_id", F.lit(1).alias("hit"))
    row = want.join(got, ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0


def tune(index: IvfIndex, queries: DataFrame, k: int = 10, target: float = 0.95, most: int = TUNED, seed: int = 11) -> tuple[IvfIndex, float]:
    """The index with the least probes whose recall reaches the target on `most` of the queries, drawn by hash, and that recall; stored with it.

    One exact search: a true neighbour is found as soon as its cell is probed, so its cell's place in the query's order says from how many probes on.
    """
    some = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(most).toArrow().to_pylist()  # not collect(), for which each task sends so many
    if not some or not len(index.centroids):
        return index, 1.0
    drawn = index.spark.createDataFrame([(i, r["vector"]) for i, r in enumerate(some)], "query_id int, vector array<double>")
    true = search(index, drawn, k, exact=True).select("query_id", "vec_id").join(index.table.select("vec_id", "cell").distinct(), "vec_id").collect()  # most x k rows
    asked = {r.query_id for r in true}
    if not asked:
        return index, 1.0
    order = {i: {int(c): n for n, c in enumerate(probed(index, np.array([some[i]["vector"]], np.float64), len(index.centroids))[0])} for i in asked}
    needed = np.sort([order[r.query_id][r.cell] + 1 for r in true])
    probes = int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])
    best = replace(index, probes=probes)
    _note(best)
    return best, float((needed <= probes).mean())


def files_read(index: IvfIndex, queries: DataFrame, probes: int | None = None) -> tuple[int, int]:
    """Files that a search of these queries opens, and all files of the index."""
    rows = np.array([r.vector for r in queries.select("vector").limit(BLOCK).collect()], np.float64)
    wanted = np.unique(probed(index, rows, probes or index.probes))
    opened = lambda t: t.select("_metadata.file_path").distinct().count()
    return opened(index.table.where(F.col("cell").isin([int(c) for c in wanted]))), opened(index.table)
