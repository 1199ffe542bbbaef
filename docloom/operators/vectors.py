"""Vector retrieval: brute-force similarity of every stored vector to a table of query vectors, and what follows it.

The query side is the caller's input; it is broadcast after its size has been checked, and larger
tables of queries are taken in blocks of that size. Stored vectors are scanned once for each block and dealt out to all cores;
a task works through them in tiles of bounded size, and only its k best of each query leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import scan
from docloom.operators.keyword import top_k

#: Query vectors that are broadcast at once.
BLOCK = 10_000


def scores(store: DataFrame, queries: DataFrame, metric: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding", zero: float = 0.0) -> DataFrame:
    """query_id, vec_id, score, of every stored vector and query (query_id, vector); a scan of the store for each block of queries. zero: the cosine of a zero vector."""
    if metric not in ("cosine", "angular"):
        return _scores(store, queries, vx.METRICS[metric], vec_id, embedding)
    clamped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(zero))))
    s = signed_scores(store, queries, vec_id, embedding)
    return s.withColumn("score", clamped(F.col("score")) if metric == "cosine" else 1 - F.acos(clamped(F.col("score"))) / F.pi())


def signed_scores(store: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cosine in [-1, 1] of every stored vector and query, null for a zero vector; norms are computed once a row, not once a pair."""
    s = store.select(vec_id, embedding, vx.norm(F.col(embedding)).alias("_norm"))
    q = queries.select("query_id", "vector", vx.norm(F.col("vector")).alias("_norm"))
    return _scores(s, q, vx.dot_raw, vec_id, embedding, lambda d: vx.cosine_of(d, F.col("nq") * F.col("nv")), ("_norm",))


def _scores(store: DataFrame, queries: DataFrame, fn: Callable[[Column, Column], Column], vec_id: str, embedding: str, last: Callable[[Column], Column] = lambda c: c, more: tuple[str, ...] = ()) -> DataFrame:
    base = store.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), *(F.col(c).alias("nv") for c in more))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"), *(F.col(c).alias("nq") for c in more))
    n = q.limit(BLOCK + 1).count()
    parts = [q] if n <= BLOCK else [q.where(F.pmod(F.xxhash64("query_id"), F.lit(m)) == i) for m in [-(-q.count() // BLOCK) * 2] for i in range(m)]
    out = [base.join(F.broadcast(p), F.size("v") == F.size("q")).select("query_id", "vec_id", last(fn(F.col("q"), F.col("v"))).alias("score")) for p in parts]
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first


def knn(store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", least: float | None = None, where: Column | None = None, **names) -> DataFrame:
    """The k nearest of each query with rank. where filters the store before anything is computed; least drops after ranks are given. names: columns, and zero as for scores()."""
    found = top_k(_nearest(store if where is None else store.where(where), queries, k, metric, **names), k, tie="vec_id")
    return found.where(F.col("score") >= least) if least else found


def knn_matrix(store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """knn() of the vectors without null components; others do not take part."""
    return knn(store.where(F.forall(F.col(embedding), lambda x: x.isNotNull())), queries, k, metric, vec_id=vec_id, embedding=embedding)


def _filled(v: Column, metric: str) -> Column:
    """Vectors with null components: like the zero vector where scores come from products; without distance to any, and null, elsewhere."""
    v = v.cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull()), v).otherwise(F.transform(v, lambda _: F.lit(0.0)) if metric not in ("euclidean", "manhattan") else F.lit(None))


def blocks_of(queries: DataFrame) -> list[DataFrame]:
    """queries in parts of about BLOCK rows, by hash of the id."""
    n = queries.count()
    of = 1 if n <= BLOCK else -(-n // BLOCK) * 2
    return [queries] if of == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(of)) == i) for i in range(of)]


def _nearest(store: DataFrame, queries: DataFrame, k: int, metric: str, vec_id: str = "vec_id", embedding: str = "embedding", zero: float = 0.0) -> DataFrame:
    """query_id, vec_id, score of the k nearest of each task and query: a scan of the store, dealt out to all cores, for each block of queries."""
    kind = dict(store.dtypes)[vec_id]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        found = scores(store, queries, metric, vec_id, embedding, zero) if metric != "signed" else signed_scores(store, queries, vec_id, embedding).where("score IS NOT NULL")
        return top_k(found, k, tie="vec_id").drop("rank")
    spark = store.sparkSession
    base = store.select(F.col(vec_id).cast("long").alias("vec_id"), _filled(F.col(embedding), metric).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    base = base.repartition(spark.sparkContext.defaultParallelism)  # vectors are small against the work on them
    out = None
    for part in blocks_of(queries.select("query_id", _filled(F.col("vector"), metric).alias("vector")).where("vector IS NOT NULL")):
        asked = part.toArrow()  # at most about BLOCK rows
        if not asked.num_rows:
            continue
        found = base.mapInArrow(_best(spark.sparkContext.broadcast(by_length(asked["vector"].combine_chunks())), k, metric, zero), "q int, vec_id long, score double")
        named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(asked.num_rows, dtype=np.int32)), "query_id": asked["query_id"]}))
        found = found.join(F.broadcast(named), "q").select("query_id", F.col("vec_id").cast(kind).alias("vec_id"), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select("query_id").limit(0).withColumns({"vec_id": F.lit(0).cast(kind), "score": F.lit(0.0)})
    return out


def by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the places of the vectors that have it, and those as a matrix."""
    length = np.diff(np.asarray(vectors.offsets))
    out = {}
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        some = vectors if len(at) == len(length) else vectors.take(pa.array(at))
        out[d] = at, np.asarray(some.flatten(), np.float64).reshape(len(at), d)
    return out


def folded(parts: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Sum of components one after another, as the column expressions add them, so that equal vectors have equal scores."""
    total = np.zeros(n)
    for x in parts:
        total += x
    return total


def norms_of(v: np.ndarray) -> np.ndarray:
    return np.sqrt(folded((x * x for x in v.T), len(v)))


class Nearest:
    """The k nearest of each of some queries among vectors given tile by tile.

    A matrix product tells which pairs of a tile can be among the k best, with a margin for its rounding; those alone are scored
    component after component, in double precision. Only the k best of each query are held.
    """

    #: Queries and vectors of a tile, pairs scored at once, queries whose city-block distances are summed at once.
    Q, V, PAIRS, L1 = 256, 2048, 1 << 15, 32

    def __init__(self, q: np.ndarray, k: int, metric: str, zero: float = 0.0):
        self.q, self.k, self.metric, self.zero = q, k, metric, zero
        self.norm = norms_of(q)
        self.unit = _unit(q, self.norm)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores, self.measures = np.full((len(q), k), -np.inf), np.full((len(q), k), -np.inf)
        self.n = np.zeros(len(q), np.int64)

    def add(self, ids: np.ndarray, v: np.ndarray, who: np.ndarray | None = None) -> None:
        """who: places of the queries that these vectors are for; without it all."""
        with np.errstate(all="ignore"):
            for a in range(0, len(v), self.V):
                tile, own = v[a : a + self.V], ids[a : a + self.V]
                norm = norms_of(tile)
                unit = _unit(tile, norm)
                for b in range(0, len(self.q if who is None else who), self.Q):
                    self._tile(slice(b, b + self.Q) if who is None else who[b : b + self.Q], own, tile, norm, unit)

    def _rough(self, at: slice | np.ndarray, v: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """What orders the pairs of a tile, and by how much it may be off."""
        if self.metric in ("cosine", "angular", "signed"):
            c = self.unit[at] @ unit.T
            if self.metric == "signed":
                c[:, norm == 0] = -np.inf
            elif self.zero:
                c[:, norm == 0] = c[self.norm[at] == 0] = self.zero
            return (c if self.metric == "signed" else np.clip(c, 0, 1, out=c)), 1e-10
        q, n = self.q[at], self.norm[at]
        if self.metric == "manhattan":
            x, y = q.astype(np.float32), np.ascontiguousarray(v.T, np.float32)
            total = np.zeros((len(q), len(v)), np.float32)
            part = np.empty((self.L1, len(v)), np.float32)
            for a in range(0, len(q), self.L1):  # so few rows at once that they stay in a core's cache
                some = total[a : a + self.L1]
                for j in range(len(y)):
                    some += np.abs(np.subtract(x[a : a + self.L1, j, None], y[None, j], out=part[: len(some)]), out=part[: len(some)])
            most = np.abs(q).sum(axis=1) + np.abs(v).sum(axis=1).max(initial=0.0)
            return np.negative(total, out=total), (len(y) + 8) * 1.2e-7 * most
        high = norm.max(initial=0.0)
        d = q @ v.T
        if self.metric == "dot":
            return np.maximum(d, 0, out=d), 1e-11 * n * high
        d *= 2
        d -= (n * n)[:, None]
        d -= (norm * norm)[None, :]
        return d, 1e-11 * (n + high) ** 2

    def _tile(self, at: slice | np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> None:
        s, slack = self._rough(at, v, norm, unit)
        least = self.measures[at, -1].copy()  # of the k-th found, -inf before there are k
        new = self.n[at] < self.k
        if new.any() and s.shape[1] > self.k:
            least[new] = np.partition(s[new], -self.k, axis=1)[:, -self.k]
        x = np.abs(least)
        if self.metric == "euclidean":  # distances so near that their scores are equal
            slack = slack + 1e-14 * (x + np.sqrt(x)) + 1e-28
        elif self.metric == "manhattan":
            slack = slack + 1e-14 * (1 + x)
        row, col = np.nonzero(~(s < (least - slack)[:, None]))  # what is no number is looked at too
        if not len(row):
            return
        row = row + at.start if isinstance(at, slice) else at[row]
        score, measure = np.empty(len(row)), np.empty(len(row))
        for a in range(0, len(row), self.PAIRS):
            r, c = row[a : a + self.PAIRS], col[a : a + self.PAIRS]
            score[a : a + self.PAIRS], measure[a : a + self.PAIRS] = exact(self.q[r], v[c], self.norm[r], norm[c], self.metric, self.zero)
        self._keep(row, ids[col], score, measure)

    def _keep(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray, measure: np.ndarray) -> None:
        if self.metric == "signed":  # zero vectors have no cosine
            there = ~np.isneginf(measure)
            row, ids, score, measure = row[there], ids[there], score[there], measure[there]
            if not len(row):
                return
        who = np.unique(row)
        # those held and the new ones, by query; what is no number comes first, as Spark sorts it
        held = np.arange(self.k)[None, :] < self.n[who][:, None]
        r = np.concatenate([np.repeat(who, held.sum(axis=1)), row])
        i, z, m = (np.concatenate([old[who][held], now]) for old, now in ((self.ids, ids), (self.scores, score), (self.measures, measure)))
        order = np.lexsort((i, -np.where(np.isnan(z), 0, z), ~np.isnan(z), r))
        r = r[order]
        first = np.searchsorted(r, who)
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        take = place < self.k
        r, place, order = r[take], place[take], order[take]
        self.ids[r, place], self.scores[r, place], self.measures[r, place] = i[order], z[order], m[order]
        self.n[who] = np.minimum(self.k, np.diff(np.append(first, len(take))))

    def rows(self, places: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        held = np.arange(self.k)[None, :] < self.n[:, None]
        for a in range(0, len(self.q), size):
            h = held[a : a + size]
            q = np.repeat(places[a : a + size].astype(np.int32), h.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.ids[a : a + size][h]), pa.array(self.scores[a : a + size][h])], names=["q", "vec_id", "score"])


def _unit(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] != 0)


def exact(q: np.ndarray, v: np.ndarray, nq: np.ndarray, nv: np.ndarray, metric: str, zero: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Score of each pair of rows as the column expressions give it, and what orders it before it is made a score."""
    pairs = zip(q.T, v.T, strict=True)
    if metric == "manhattan":
        d = folded((np.abs(x - y) for x, y in pairs), len(q))
        return 1 / (1 + d), -d
    if metric == "euclidean":
        d = folded(((x - y) * (x - y) for x, y in pairs), len(q))
        return 1 / (1 + np.sqrt(d)), -d
    d = folded((x * y for x, y in pairs), len(q))
    if metric == "dot":
        d = np.where(d <= 0, 0.0, d)
        return d, d
    norms = nq * nv
    c = d / norms
    if metric == "signed":
        return c, np.where(norms == 0, -np.inf, c)
    c = np.where(norms == 0, zero, np.where(np.isnan(c), 1.0, np.clip(c, 0, 1)))
    return (c if metric == "cosine" else 1 - np.arccos(c) / np.pi), c


def _best(shared, k: int, metric: str, zero: float):
    """Of each query the k nearest of a task's vectors, given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: (at, Nearest(q, k, metric, zero)) for d, (at, q) in shared.value.items()}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for d, (at, v) in by_length(batch.column(1)).items():
                if d in asked:
                    asked[d][1].add(ids[at], v)
        for at, found in asked.values():
            yield from found.rows(at)

    return run


def signed_knn(store: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cosine in [-1, 1]; zero vectors have none and are left out."""
    return top_k(_nearest(store, queries, k, "signed", vec_id=vec_id, embedding=embedding), k, tie="vec_id")


def where_clause(include: dict | None = None, exclude: dict | None = None, ranges: dict | None = None, contains: dict | None = None, substring: bool = False) -> Column | None:
    """Equalities, inequalities, inclusive ranges and text conditions (equality, or substrings if asked), all joined by AND; None for none."""
    parts = [F.col(c) == v for c, v in (include or {}).items()] + [F.col(c) != v for c, v in (exclude or {}).items()]
    parts += [F.col(c).between(*v) for c, v in (ranges or {}).items()]
    parts += [F.contains(F.lower(F.col(c)), F.lit(v.lower())) if substring else F.col(c) == v for c, v in (contains or {}).items()]
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def group_pairs(store: DataFrame, queries: DataFrame, group: str, metric: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """group_id, place, score of every stored vector and query (query_id, vector).

    Places count a group's pairs from 0, query after query and vectors by id. A pair's place follows from its query's number, its vector's
    number in the group, and the group's size; both numbers come from scans by ranges, so no pairs are sorted.
    """
    base = store.select(F.col(vec_id).alias("v"), F.col(group).alias("g"), F.col(embedding).alias("e")).withColumn("one", F.lit(1))
    size = base.groupBy(F.col("g").alias("g2")).agg(F.count("*").alias("n"))
    numbered = scan.running(base, ["g"], ["v"], "one").join(size, F.col("g").eqNullSafe(F.col("g2")))
    tagged = numbered.select(F.struct("g", (F.col("running_n") - 1).alias("at"), "n").alias("tag"), "e")
    asked = scan.running(queries.select("query_id", "vector").withColumn("one", F.lit(1)), [], ["query_id"], "one")
    found = scores(tagged, asked.select(F.struct("query_id", (F.col("running_n") - 1).alias("at")).alias("query_id"), "vector"), metric, "tag", "e")
    return found.select(F.col("vec_id.g").alias("group_id"), (F.col("query_id.at") * F.col("vec_id.n") + F.col("vec_id.at")).alias("place"), "score")


def multi_vector(pairs: DataFrame, how: str = "mean") -> DataFrame:
    """group_id, score, from rows (group_id, place, score): mean, max, or the mean weighted by exp(-place/10) ("concat")."""
    w = F.exp(-0.1 * F.col("place"))
    agg = {"mean": F.avg("score"), "max": F.max("score"), "concat": F.sum(w * F.col("score")) / F.sum(w)}[how]
    return pairs.groupBy("group_id").agg(agg.alias("score"))


#: From this place on exp(-place / 10) is 0 in double precision: such pairs add nothing, not even a rounding.
WEIGHTLESS = 7460


def multi_vector_of(store: DataFrame, queries: DataFrame, group: str, how: str = "mean", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """multi_vector() over group_pairs() by cosine, without a row for each pair: every task sums its tiles of pairs by group, and the sums meet.

    Vectors with null components count as zero vectors, whose cosine is 0. For "concat" only pairs before WEIGHTLESS are scored; the weight of all others is 0.
    """
    spark, kind = store.sparkSession, dict(store.dtypes)[group]
    base, asked = store.select(F.col(vec_id).alias("v"), F.col(group).alias("g"), _filled(F.col(embedding), "cosine").alias("e")).withColumn("one", F.lit(1)), queries.select("query_id", _filled(F.col("vector"), "cosine").alias("vector")).withColumn("one", F.lit(1))
    if how == "concat":
        size = base.groupBy(F.col("g").alias("g2")).agg(F.count("*").alias("n"))
        base = scan.running(base, ["g"], ["v"], "one").join(size, F.col("g").eqNullSafe(F.col("g2"))).withColumn("at", F.col("running_n") - 1)
        asked = scan.running(asked, [], ["query_id"], "one").withColumn("at", F.col("running_n") - 1)
        base, asked = base.where(F.col("at") < WEIGHTLESS), asked.where(F.col("at") < WEIGHTLESS)
    else:
        base, asked = base.withColumns({"at": F.lit(0).cast("long"), "n": F.lit(1).cast("long")}).repartition(spark.sparkContext.defaultParallelism), asked.withColumn("at", F.lit(0).cast("long"))
    base, out = base.where("e IS NOT NULL").select("g", "at", "n", "e"), None
    for part in blocks_of(asked.where("vector IS NOT NULL").select("query_id", "at", "vector")):
        rows = part.select("at", "vector").toArrow()  # at most about BLOCK rows
        at = np.asarray(rows["at"])
        shared = {d: (at[i], _unit(q, norms_of(q))) for d, (i, q) in by_length(rows["vector"].combine_chunks()).items()} if len(at) else {}
        found = base.mapInArrow(_sums(spark.sparkContext.broadcast(shared), how), f"g {kind}, total double, weight double")
        out = found if out is None else out.unionByName(found)
    score = F.max("total") if how == "max" else F.sum("total") / F.sum("weight")
    return out.groupBy(F.col("g").alias("group_id")).agg(score.alias("score"))


def _sums(shared, how: str, tile: int = 2048, block: int = 256):
    """g, total, weight: a row for each group of a task's vectors that meets a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[float]] = {}
        for batch in batches:
            groups = batch.column(0).dictionary_encode("encode")
            code, names = np.asarray(groups.indices), groups.dictionary.to_pylist()
            place, size = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for d, (at, v) in by_length(batch.column(3)).items():
                for a in range(0, len(v) if d in shared.value else 0, tile):
                    some = at[a : a + tile]
                    v_at, n = place[some], size[some]
                    q_at, q = shared.value[d]
                    if how == "concat":
                        near = q_at * n.min() < WEIGHTLESS
                        q_at, q = q_at[near], q[near]
                    unit = _unit(v[a : a + tile], norms_of(v[a : a + tile]))
                    total, weight = np.full(len(some), -np.inf if how == "max" else 0.0), np.zeros(len(some))
                    for b in range(0, len(q), block):
                        c = q[b : b + block] @ unit.T
                        c = np.where(np.isnan(c), 1.0, np.clip(c, 0, 1, out=c))
                        if how == "max":
                            np.maximum(total, c.max(axis=0), out=total)
                        elif how == "mean":
                            total += c.sum(axis=0)
                            weight += len(c)
                        else:
                            w = np.exp(-0.1 * (q_at[b : b + block, None] * n[None, :] + v_at[None, :]))
                            total += (w * c).sum(axis=0)
                            weight += w.sum(axis=0)
                    for g in np.unique(code[some]).tolist() if len(q) else []:
                        mine = code[some] == g
                        now = held.setdefault(names[g], [-np.inf if how == "max" else 0.0, 0.0])
                        now[0] = max(now[0], float(total[mine].max())) if how == "max" else now[0] + float(total[mine].sum())
                        now[1] += float(weight[mine].sum())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), groups.type.value_type), pa.array([x[0] for x in held.values()]), pa.array([x[1] for x in held.values()])], names=["g", "total", "weight"])

    return run


def prepare_query(text: Column, most: int = 512, abbreviations: dict | None = None) -> Column:
    """Trimmed, lower-cased, cut to `most` characters, abbreviations followed by what they stand for."""
    table = F.create_map(*(F.lit(x) for kv in (abbreviations or lx.QUERY_ABBREVIATIONS).items() for x in kv))
    return F.array_join(F.transform(tx.words(F.left(F.lower(F.trim(text)), F.lit(most))), lambda w: F.concat_ws(" ", w, F.element_at(table, w))), " ")


def expand(queries: DataFrame, how: str = "synonyms") -> DataFrame:
    """query_id, variant, text: the text itself (variant 0) and its variants, distinct."""
    text = F.lower("text")
    words = tx.words(text)
    none = F.array().cast("array<string>")
    if how == "synonyms":
        table = F.create_map(*(x for k, v in lx.QUERY_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        replaced = lambda w: F.transform(F.coalesce(F.element_at(table, w), none), lambda s: F.replace(text, w, s))
        more = F.slice(F.flatten(F.transform(words, replaced)), 1, 3)
    elif how == "domain":
        more = F.when(tx.contains_any(text, lx.SEMANTIC_TERMS), F.array(*(F.concat(F.col("text"), F.lit(f" {s}")) for s in lx.DOMAIN_SUFFIXES))).otherwise(none)
    elif how == "multilingual":
        table = F.create_map(*(F.lit(x) for kv in lx.TRANSLATIONS.items() for x in kv))
        more = F.transform(F.filter(words, lambda w: F.element_at(table, w).isNotNull()), lambda w: F.replace(text, w, F.element_at(table, w)))
    else:
        more = none
    return queries.select("query_id", F.posexplode(F.array_distinct(F.concat(F.array("text"), more))).alias("variant", "text"))


def candidates(found: DataFrame) -> DataFrame:
    """Best score of each (query_id, doc_id) over variants, then the first of rows that begin with the same 200 characters."""
    best = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.first("content").alias("content"))
    order = W.partitionBy("query_id", F.left("content", F.lit(200))).orderBy(F.desc("score"), "doc_id")
    return best.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def semantic(store: DataFrame, variants: DataFrame, contents: DataFrame, k: int = 5, least: float = 0.1, recent: Column | None = None, most: int = 100, **names) -> DataFrame:
    """The k best documents of each query over its variants, with boosts.

    variants: query_id, variant, vector; contents: doc_id, content. Each variant fetches min(2k, most); a document has the best of
    its scores, of texts that begin alike the best stays; boosts follow, then the least score, then ranks.
    """
    q = variants.select(F.struct("query_id", "variant").alias("query_id"), "vector")
    found = knn(store, q, min(2 * k, most), **names).select(F.col("query_id.query_id").alias("query_id"), F.col("vec_id").alias("doc_id"), "score")
    best = candidates(found.join(contents.select("doc_id", "content"), "doc_id"))
    scored = best.withColumn("score", boosted(F.col("content"), F.col("score"), recent=recent))
    return top_k(scored.where(F.col("score") >= least), k).select("query_id", "doc_id", "score", "rank")


def boosted(content: Column, score: Column, technical: float = 1.2, safety: float = 1.5, recent: Column | None = None) -> Column:
    """Boosts by vocabulary (and by 1.05 where recent holds), capped at 1."""
    low = F.lower(content)
    s = score * F.when(tx.contains_any(low, lx.SEMANTIC_TERMS), technical).otherwise(1.0) * F.when(tx.contains_any(low, lx.SAFETY_KEYWORDS), safety).otherwise(1.0)
    return F.least(F.lit(1.0), s if recent is None else s * F.when(recent, 1.05).otherwise(1.0))


def rerank_by_shape(content: Column, query: Column, score: Column) -> Column:
    """Short and very long texts count a little less, shared words a little more."""
    length = F.when(F.length(content) < 100, 0.9).when(F.length(content) > 5000, 0.95).otherwise(1.0)
    shared = F.size(F.array_intersect(tx.word_set(query), tx.word_set(content)))
    return score * length * (1 + 0.05 * shared)


def metadata_equal(metadata: Column, wanted: dict[str, str], missing_matches: bool = False) -> Column:
    """Equality on a map column; a missing key fails, or passes if asked."""
    out = F.lit(True)
    for k, v in wanted.items():
        got = F.try_element_at(metadata, F.lit(k))
        out = out & (F.coalesce(got == v, F.lit(missing_matches)))
    return out
