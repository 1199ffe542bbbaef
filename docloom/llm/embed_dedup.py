"""Embedding near-duplicates by sorted projection passes.

In each pass a vector's key is the concatenation of 64 random hashes, the signs of its projections
on random directions; vectors are ordered by key and each is compared with the next `window` of the
order, by cosine in double precision. Links that hold are united across passes into components. All
passes are rows of one table with one sort: a row's place in the order, counted exactly from
partition sizes, assigns it to a block, and the first rows of a block also go to the block before,
so no window ends at a border. A block emits the links that connect something new, not all pairs.

The first passes follow from the number of vectors n, as if keys were spread evenly: two vectors at
the threshold agree in one sign with probability p = 1 - acos(t)/pi, and must agree in the first
log2(n / window) + 1. Whether that was enough is measured, since vectors that are alike crowd the
order: in each pass, for each vector, the leading bits b after which no key beyond the window agrees
with its own. A partner that agrees in b bits was met, so the chance to have missed one is the
product of 1 - p**b over the passes. Vectors whose product is above `miss` are open; a pair can only
have been missed if both are. While they are more than `EXACT`, the open ones go on, among
themselves, in further passes of wider windows; the rest are compared with each other in full.

A window bounds the partners of one pass. For the rest there is an exact way: within each component
all vectors are compared in blocks of bounded size, which counts every direct link of a group,
however dense; only counts leave the task, and a vector is sent once for each block of its component. Equal vectors are one class with a multiplicity before
all this, so copies never expand to pairs.

Defined results: vectors that are null, empty, zero, or have null or non-finite components, and
rows without id, link with nothing; vectors of different length never link; equal cosines need no order, since links are a set; rows of one id count
as vectors of their own and share a component; repeated rows are one class; a very long vector is compared whole; other columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.frames import pick
from docloom.llm.ngram_join import Union
from docloom.llm.scratch import Scratch

#: Cosine that links; vectors after each that it is compared with; bits of a key; chance to miss a pair at the threshold.
COSINE, WINDOW, BITS, MISS = 0.95, 64, 64, 0.005
#: Rows of a block of the order, vectors of a block within a component, and of a tile of its products.
BLOCK, PART, TILE = 4096, 8192, 512
#: Open vectors up to which all pairs are compared, growth and limit of the windows of further passes before that, vectors of a block of all pairs.
EXACT, WIDER, WIDEST, SQUARE = 1 << 17, 8, 4096, 8192


def passes_for(n: int, window: int = WINDOW, cosine: float = COSINE, miss: float = MISS) -> int:
    bits = max(1.0, math.log2(max(2, n) / window) + 1)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return max(8, math.ceil(math.log(miss) / math.log(1 - min(meet, 1 - 1e-9))))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length, in double precision, of packed vectors: their components as they were given, single or double."""
    raw = [v.as_py() for v in col]
    kind = np.float32 if raw and len(raw[0]) == 4 * dim else np.float64
    x = _scaled(np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Divided by the largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1)[:, None]


def _keys(passes: int, seed: int):
    """A row for each pass with its key; the vector travels packed in the precision that it came in."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, vec = np.array(batch.column(0)), batch.column(1)
            dims = np.diff(np.array(vec.offsets))
            flat = np.array(vec.flatten())
            starts = np.concatenate(([0], np.cumsum(dims)))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                given = np.stack([flat[starts[r] : starts[r] + dim] for r in rows])
                x = _scaled(given.astype(np.float64))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))
                signs = (x @ planes[dim] >= 0).reshape(len(rows), passes, BITS)
                key = np.packbits(signs, axis=2).view(">u8").astype(np.uint64)[:, :, 0]
                key = (key ^ np.uint64(1 << 63)).view(np.int64)  # so that signed order is the order of bits
                raw = [v.tobytes() for v in given]
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), p, np.int32)), pa.array(key[:, p]), pa.array(rep[rows]), pa.array(raw, pa.binary())], names=["dim", "pass", "key", "rep", "vec"])

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("missed", pa.float64())])


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bits in which keys agree."""
    z = (x ^ y).view(np.uint64)
    return 64 - np.frexp((z & ~(z >> np.uint64(1))).astype(np.float64))[1]  # the highest bit stays, rounding cannot reach it


def _windows(window: int, cosine: float):
    """Links (a, b), and for each own row (a, null) the logarithm of the chance that it missed a partner in this pass."""
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rep, dims, turn, own, key = (np.array(table[c]) for c in ("rep", "dim", "pass", "own", "key"))
        a, b, reps, missed = [], [], [], []
        # a block may hold the end of one pass or length of vector and the start of the next
        cut = np.flatnonzero((dims[1:] != dims[:-1]) | (turn[1:] != turn[:-1])) + 1
        for s, e in zip([0, *cut], [*cut, len(rep)], strict=True):
            if not own[s:e].any():
                continue
            bits, far = np.full(e - s, -1), window + 1
            if e - s > far:
                same = _agreeing(key[s : e - far], key[s + far : e])
                bits[:-far] = same
                bits[far:] = np.maximum(bits[far:], same)
            mine = np.flatnonzero(own[s:e])
            reps.append(rep[s:e][mine])
            missed.append(np.log(np.maximum(1 - agree ** (bits[mine] + 1.0), 1e-300)))
            x = _matrix(table["vec"].slice(s, e - s), int(dims[s]))
            u = Union(e - s)
            if window > WINDOW:  # tiles of rows against the rows that their windows cover
                for i in range(0, e - s, 256):
                    z = min(e - s, i + 256 + window)
                    hit = x[i : i + 256] @ x[i:z].T >= cosine
                    d = np.arange(z - i)[None, :] - np.arange(len(hit))[:, None]
                    hit &= (d > 0) & (d <= window) & own[s + i : s + i + len(hit), None]
                    _join(u, hit, np.arange(i, i + len(hit)), np.arange(i, z), a, b, rep[s:e])
                continue
            for d in range(1, min(window, e - s - 1) + 1):
                root = u.roots()
                i = np.flatnonzero((root[:-d] != root[d:]) & own[s : e - d])
                i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine]
                for k in i.tolist():
                    if u.join(k, k + d):
                        a.append(rep[s + k])
                        b.append(rep[s + k + d])
        return _emit(a, b, reps, missed)

    return run


def _join(u: Union, hit: np.ndarray, rows: np.ndarray, cols: np.ndarray, a: list, b: list, rep: np.ndarray) -> None:
    """Unites what hit (rows x cols, numbers in u) links, and appends the links that connect something new."""
    for k in np.flatnonzero(hit.any(axis=1)).tolist():
        root = u.roots()
        for y in cols[hit[k] & (root[cols] != root[rows[k]])].tolist():
            if u.join(int(rows[k]), y):
                a.append(rep[rows[k]])
                b.append(rep[y])


def _emit(a: list, b: list, reps: list, missed: list) -> pa.Table:
    open_ = np.concatenate(reps) if reps else np.zeros(0, np.int64)
    ends = pa.chunked_array([pa.array(b, pa.int64()), pa.nulls(len(open_), pa.int64())])
    chance = pa.chunked_array([pa.nulls(len(a), pa.float64()), pa.array(np.concatenate(missed) if missed else [], pa.float64())])
    return pa.table([pa.chunked_array([pa.array(a, pa.int64()), pa.array(open_, pa.int64())]), ends, chance], schema=_LINKS)


def _squares(cosine: float):
    """New links between vectors of different components, of blocks i and j of a length of vector, all pairs."""

    def run(table: pa.Table) -> pa.Table:
        dim, i, j, side, rep, comp = (np.array(table[c]) for c in ("dim", "i", "j", "side", "rep", "component"))
        order = np.lexsort((rep, side, j, i, dim))
        key = np.stack([dim[order], i[order], j[order]])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]))
        a, b = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            r = order[s:e]
            if not len(r):
                continue
            x = _matrix(table["vec"].take(pa.array(r)), int(dim[r[0]]))
            _, group = np.unique(comp[r], return_inverse=True)
            u = Union(len(r))
            for g in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1]):
                u.up[g] = g[0]
            half = np.flatnonzero(side[r] == i[r[0]])
            cols = half if i[r[0]] == j[r[0]] else np.flatnonzero(side[r] != i[r[0]])
            for at in range(0, len(half), 256):
                rows = half[at : at + 256]
                hit = (x[rows] @ x[cols].T >= cosine) & (group[rows][:, None] != group[cols][None, :])
                _join(u, hit, rows, cols, a, b, rep[r])
        return _emit(a, b, [], [])

    return run


_COUNTS = pa.schema([("rep", pa.int64()), ("n", pa.int64())])


def _degrees(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        c, i, j, side, dim, rep, m = (np.array(table[x]) for x in ("component", "i", "j", "side", "dim", "rep", "m"))
        order = np.lexsort((rep, side, j, i, c))
        key = np.stack([c[order], i[order], j[order]])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]))
        reps, counts = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            rows = order[s:e]
            for d in np.unique(dim[rows]).tolist():
                r = rows[dim[rows] == d]
                x, n = _matrix(table["vec"].take(pa.array(r)), d), np.zeros(len(r), np.int64)
                alone = i[r[0]] == j[r[0]]
                low = np.arange(len(r)) if alone else np.flatnonzero(side[r] == i[r[0]])
                high = low if alone else np.flatnonzero(side[r] != i[r[0]])
                for at in range(0, len(low), TILE):
                    some = low[at : at + TILE]
                    hit = x[some] @ x[high].T >= cosine
                    if alone:
                        hit[np.arange(len(some)), some] = False
                    n[some] += hit @ m[r[high]]
                    if not alone:
                        n[high] += hit.T @ m[r[some]]
                reps.append(rep[r])
                counts.append(n)
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(reps), cat(counts)], schema=_COUNTS)

    return run


def _passes(vectors: DataFrame, n: int, window: int, cosine: float, miss: float, seed: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b, missed: what _windows() finds in the passes over n vectors (rep, vec)."""
    keys = vectors.mapInArrow(_keys(passes_for(n, window, cosine, miss), seed), "dim int, pass int, key long, rep long, vec binary")
    # one sort for all passes; the partition's number and the row's place in it, as written, give the rank
    order = scratch.table(f"order{seed}", keys.orderBy("dim", "pass", "key", "rep").withColumn("at", F.monotonically_increasing_id()))
    part_of = F.shiftrightunsigned("at", 33)
    sizes = order.groupBy(part_of.alias("pid")).count().orderBy("pid").collect()  # a row for each partition
    before, total = [], 0
    for r in sizes:
        before.append((r.pid, total))
        total += r["count"]
    offsets = F.broadcast(vectors.sparkSession.createDataFrame(before or [(0, 0)], "pid long, before long"))
    ranked = order.withColumn("pid", part_of).join(offsets, "pid").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    home = F.floor(F.col("rank") / F.lit(block)).cast("long")
    # the rows within reach of a block's own, on both sides
    at, reach = F.col("rank") % block, window + 1
    held = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    also = F.filter(F.array(held(home, True), F.when((at < reach) & (home > 0), held(home - 1, False)), F.when(at >= block - reach, held(home + 1, False))), lambda x: x.isNotNull())
    dealt = ranked.select("dim", "pass", "key", "rep", "vec", "rank", F.explode(also).alias("x")).select("dim", "pass", "key", "rep", "vec", "rank", "x.block", "x.own")
    return dealt.groupBy("block").applyInArrow(_windows(window, cosine), "a long, b long, missed double")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, seed: int = 7, block: int = BLOCK, part: int = PART, exact: int = EXACT) -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    rows = pick(vectors, vec_id=(vec_id, "bigint"), vec=(embedding, "array<float>" if single else "array<double>"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("print", F.when(usable, F.sha2(F.array_join(F.col("vec").cast("array<double>"), ","), 256)))
    classes = scratch.table("classes", rows.where(usable).groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec")))
    n = classes.count()
    total = n * passes_for(n, window, cosine, miss)
    links, left, chance, r = None, classes.select("rep", "vec"), None, 0
    while n > 0 and (r == 0 or (n > exact and window < WIDEST)):
        if r:
            window *= WIDER
        met = scratch.table(f"met{r}", _passes(left, n, window, cosine, miss, seed + r, max(block, window + 1), scratch))
        scratch.drop(f"order{seed + r}")
        links = met.where("b IS NOT NULL").select("a", "b") if links is None else links.unionByName(met.where("b IS NOT NULL").select("a", "b"))
        more = met.where("b IS NULL").select(F.col("a").alias("rep"), "missed")
        chance = (more if chance is None else chance.unionByName(more)).groupBy("rep").agg(F.sum("missed").alias("missed")).where(F.col("missed") > math.log(miss))
        chance = scratch.table(f"open{r}", chance)
        left = classes.join(chance.select("rep"), "rep").select("rep", "vec")
        n, r = chance.count(), r + 1
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    if n > 1:  # all pairs of what is still open, but those already connected
        comp = scratch.table("met-components", components(links, scratch, "met-cc"))
        member = left.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        blocks = -(-n // SQUARE)
        member = member.withColumn("side", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        raw = member.select(F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", F.size("vec").alias("dim"), "rep", "component", "vec")
        raw = raw.mapInArrow(_pack, "i int, j int, side int, dim int, rep long, component long, vec binary")
        found = scratch.table("squares", raw.groupBy("i", "j").applyInArrow(_squares(cosine), "a long, b long, missed double"))
        links = links.unionByName(found.select("a", "b"))
    comp = scratch.table("components", components(links, scratch))
    # the exact count of direct links inside each component
    large = comp.groupBy("component").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("blocks"))
    member = comp.join(large, "component").join(classes, comp.node == classes.rep)
    member = member.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = max(8, -(-total // (16 * block)))
    raw = member.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", F.size("vec").alias("dim"), "rep", "m", "vec")
    raw = raw.withColumn("task", F.pmod(F.xxhash64("component", "i", "j"), F.lit(tasks)).cast("int"))
    raw = raw.mapInArrow(_pack, "component long, i int, j int, side int, dim int, rep long, m long, task int, vec binary")
    degree = raw.groupBy("task").applyInArrow(_degrees(cosine), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("print", "rep", "m").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(F.col("print").alias("p"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", "print").join(named, F.col("print") == F.col("p"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(False)).alias("kept"))


def _pack(batches):
    for batch in batches:
        if batch.num_rows:
            vec = batch.column(batch.schema.get_field_index("vec"))
            raw = [np.array(v.values).tobytes() for v in vec]
            names = [n for n in batch.schema.names if n != "vec"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(raw, pa.binary())], names=[*names, "vec"])


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT rid, x, len(x) AS n, sqrt(list_dot_product(x, x)) AS s FROM v
  WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM u a JOIN u b ON a.n = b.n AND a.rid <> b.rid WHERE list_dot_product(a.x, b.x) / (a.s * b.s) >= 0.95),
r AS (SELECT rid AS a, rid AS z FROM v UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z),
k AS (SELECT a AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.z GROUP BY a),
n AS (SELECT x AS rid, count(*) AS n_links FROM e GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN k USING (rid) LEFT JOIN n USING (rid)
"""


def brute_force(rows: list[tuple], cosine: float = COSINE) -> dict:
    """vec_id to (n_links, component_id) over all pairs, for tests."""
    ok = [(i, np.array(v, np.float64) / max(map(abs, v))) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    u, n = Union(len(ok)), [0] * len(ok)
    for x, (_, a) in enumerate(ok):
        for y in range(x):
            b = ok[y][1]
            if len(a) == len(b) and float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)) >= cosine:
                n[x] += 1
                n[y] += 1
                u.join(x, y)
    low: dict[int, int] = {}
    for x, (i, _) in enumerate(ok):
        r = u.find(x)
        low[r] = min(low.get(r, i), i)
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (n[x], low[u.find(x)]) for x, (i, _) in enumerate(ok)}
