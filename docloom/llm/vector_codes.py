"""Vector code compression: product codes whose codebooks come from Lloyd rounds with heaps.

Each vector is cut into parts, each part position has a codebook, and a vector's code names the nearest
entry of each part. Vectors travel in blocks. For each entry of each codebook a block holds a heap of the
parts assigned to it, keyed by slack: the distance to the second nearest entry less that to its own, plus
the drift that the entry had gathered when the part was put in. Entries drift as they move: a round adds
to an entry's drift its own move and the farthest move of any other entry. Parts whose key is not above
the drift may have a nearer entry now; only they are popped, from the root down, rescanned exactly and put
back. The others keep their entry without a look at any distance. Sums follow the parts that moved.

Each round is one pass over the blocks, which are written with their heaps to the shared folder; what goes
to the driver is a number for each component of each entry. Distances are exact integers; bounds are
doubles with a margin for rounding, and a part within the margin is rescanned, so ties go to the lower entry.

Defined results: rows whose vector is null or has null or non-finite components have no row in the result;
a vector shorter than the longest, or than the next multiple of the number of parts, continues with zeros,
the empty vector too; rows without id are coded but start no entry; repeated rows are vectors of their own and
may start entries of their own, of which the lower takes all; equally small ids start entries in the order of their
components; with fewer vectors than entries, codebooks are smaller; null labels are one label; integers
are held to +-2**62 and sums to the range of a long; other columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.frames import pick
from docloom.llm.integers import decimals, finite, floor_of, floors, group_sums, largest, like, long_sum, matrix, squares, to_long
from docloom.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block of vectors, and rows whose distances to all entries are held at once.
BLOCK, ROWS = 1 << 20, 2048
#: Relative error that the bounds, sums of a few square roots, stay far below.
MARGIN = 1e-9

_DELTA = pa.list_(pa.struct([("slot", pa.int32()), ("place", pa.int32()), ("sum", pa.decimal128(38, 0))]))
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int32()), ("vec", pa.binary()), ("item", pa.binary()), ("key", pa.binary()), ("size", pa.binary()), ("delta", _DELTA)])
_BLOCKS_SQL = "ids array<bigint>, labels array<string>, width int, vec binary, item binary, key binary, size binary, delta array<struct<slot:int,place:int,sum:decimal(38,0)>>"


class Block:
    """Vectors x (n, parts, w) with the heaps of their parts: item (part * n + row) and key, heap after heap, and the heaps' sizes (part * entries + entry)."""

    def __init__(self, x: np.ndarray, heaps: int, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.x, n, parts = x, *x.shape[:2]
        each = heaps // parts
        # before the first round all parts of a position wait in the heap of its entry 0, below any drift
        start = np.zeros(heaps, np.int64)
        start[::each] = n
        self.item, self.key, self.size = state or (np.arange(n * parts), np.full(n * parts, -np.inf), start)

    def heap(self) -> np.ndarray:
        """The heap of each place of item."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """Places of the parts whose key is not above their heap's drift; children are looked at only below such a part."""
        start = np.cumsum(self.size) - self.size
        bound = drift + MARGIN * drift
        heap = np.flatnonzero(self.size > 0)
        node, out = np.zeros(len(heap), np.int64), [np.zeros(0, np.int64)]
        while len(heap):
            at = start[heap] + node
            gone = self.key[at] <= bound[heap]
            out.append(at[gone])
            heap, node = np.repeat(heap[gone], 2), np.stack([2 * node[gone] + 1, 2 * node[gone] + 2], axis=1).ravel()
            inside = node < self.size[heap]
            heap, node = heap[inside], node[inside]
        return np.concatenate(out)

    def round(self, books: np.ndarray, drift: np.ndarray, first: bool) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
        """Reassigns what drift has loosened. What that adds to each slot's sums: slot, place (-1: count), value; and the parts scanned."""
        n, parts, _ = self.x.shape
        each = len(self.size) // parts
        at = self.popped(drift)
        items, heap = self.item[at], self.heap()
        home, key = np.zeros(len(at), np.int64), np.zeros(len(at))
        for p in range(parts):
            mine = np.flatnonzero(items // n == p)
            for s in range(0, len(mine), ROWS):
                some = mine[s : s + ROWS]
                best, slack = nearest(self.x[items[some] - p * n, p], books[p])
                home[some], key[some] = p * each + best, slack
        key += drift[home]
        moved = np.arange(len(at)) if first else np.flatnonzero(home != heap[at])
        delta = self._delta(items[moved], home[moved], None if first else heap[at][moved])
        if len(at):
            stay = np.ones(len(heap), bool)
            stay[at] = False
            heap, self.key, self.item = np.concatenate([heap[stay], home]), np.concatenate([self.key[stay], key]), np.concatenate([self.item[stay], items])
            order = np.lexsort((self.key, heap))  # a sorted run is a heap
            self.key, self.item, self.size = self.key[order], self.item[order], np.bincount(heap, minlength=len(self.size))
        return delta, len(at)

    def _delta(self, items: np.ndarray, home: np.ndarray, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, _, w = self.x.shape
        rows = self.x[items % n, items // n]
        out: tuple[list, list, list] = ([], [], [])
        for sign, slots in ((1, home), (-1, old)):
            if slots is None:
                continue
            slot, sums, counts = group_sums(rows, slots)
            for a, v in zip(out, (np.repeat(slot, w + 1), np.tile(np.arange(-1, w), len(slot)), sign * np.concatenate([counts[:, None].astype(sums.dtype), sums], axis=1).ravel()), strict=True):
                a.append(v)
        return tuple(np.concatenate(a) for a in out)

    def entries(self) -> np.ndarray:
        """Entry of each part (n, parts)."""
        n, parts, _ = self.x.shape
        out = np.empty(n * parts, np.int64)
        out[self.item] = self.heap() % (len(self.size) // parts)
        return out.reshape(parts, n).T


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, of equal ones the lowest, and the slack to the second nearest, less a margin."""
    d = squares(x, book)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    own = np.sqrt(d[rows, best].astype(np.float64))
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    d[rows, best] = d.max() + 1 if d.dtype == object else np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64))
    return best, second - own - MARGIN * (second + own)


def _read(batch: pa.RecordBatch, parts: int, heaps: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for r in range(batch.num_rows):
        ids, labels, width, vec, item, key, size = (batch.column(c)[r] for c in range(7))
        x = np.frombuffer(vec.as_buffer(), f"i{width.as_py()}").astype(np.int64)
        state = (np.frombuffer(item.as_buffer(), np.int32).astype(np.int64), np.frombuffer(key.as_buffer(), np.float64), np.frombuffer(size.as_buffer(), np.int32).astype(np.int64))
        yield ids.values, labels.values, Block(x.reshape(len(ids), parts, -1), heaps, state)


def _gathered(batches: Iterator[pa.RecordBatch], dim: int, parts: int, scale: int, heaps: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    """Rows (vec_id, label, vec) in blocks of about BLOCK components."""
    most, held, n = max(1, BLOCK // dim), [], 0

    def block(rows: list[pa.RecordBatch]):
        ids, labels = (pa.concat_arrays([b.column(c) for b in rows]) for c in (0, 1))
        x = np.concatenate([matrix(b.column(2), dim, scale) for b in rows])
        return ids, labels, Block(x.reshape(len(x), parts, -1), heaps)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            if n + piece.num_rows > most and held:
                yield block(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield block(held)


def _row(ids: pa.Array, labels: pa.Array, block: Block, delta: tuple[np.ndarray, np.ndarray, np.ndarray], scanned: int) -> pa.RecordBatch:
    width = next(b for b in (2, 4, 8) if largest(block.x) < 1 << (8 * b - 1))
    slot, place, value = (np.append(a, b) for a, b in zip(delta, (-1, -1, scanned), strict=True))  # slot -1: the parts scanned
    entries = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), decimals(value)], fields=list(_DELTA.value_type))
    raw = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    cols = [whole(ids), whole(labels), pa.array([width], pa.int32()), raw(block.x, f"i{width}"), raw(block.item, np.int32), raw(block.key, np.float64), raw(block.size, np.int32), whole(entries)]
    return pa.RecordBatch.from_arrays(cols, schema=_BLOCKS)


def _pass(shared, dim: int, scale: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        parts, heaps = books.shape[0], books.shape[0] * books.shape[1]
        source = _gathered(batches, dim, parts, scale, heaps) if first else (b for batch in batches for b in _read(batch, parts, heaps))
        for ids, labels, block in source:
            yield _row(ids, labels, block, *block.round(books, drift, first))

    return run


def _codes(shared):
    """The last assignment: vec_id, label, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        parts, heaps = books.shape[0], books.shape[0] * books.shape[1]
        for batch in batches:
            for ids, labels, block in _read(batch, parts, heaps):
                block.round(books, drift, False)
                entry = block.entries()
                own = books[np.arange(parts)[None, :], entry]
                a, b = like(4 * block.x.size * max(1, largest(block.x), largest(own)) ** 2, block.x, own)
                error = ((a - b) ** 2).sum(axis=(1, 2))
                text = entry.astype(np.uint8).tobytes().hex()
                code = [text[2 * parts * r : 2 * parts * (r + 1)] for r in range(len(entry))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(to_long(error), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def updated(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries as the floors of their parts' means; unused ones stay. sums and counts hold Python's integers."""
    out = books.astype(object)
    used = counts > 0
    out[used] = sums[used] // counts[used][:, None]
    return out.astype(np.int64)


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each entry's parts may have lost of their slack so far: its own moves and the farthest of the others'."""
    move = np.sqrt(((new.astype(object) - old.astype(object)) ** 2).sum(axis=2).astype(np.float64)) * (1 + MARGIN)
    top = np.sort(move, axis=1)
    far, next_ = top[:, -1:], (top[:, -2:-1] if move.shape[1] > 1 else np.zeros_like(top[:, -1:]))
    others = np.where(move == far, np.where((move == far).sum(axis=1, keepdims=True) > 1, far, next_), far)
    return drift + move + others


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, scanned (parts whose distances were computed, by round, comma-joined)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = pick(vectors, vec_id=(vec_id, "bigint"), label=(label, "string"), vec=(embedding, kind)).where(finite(F.col("vec")))
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return _empty(spark)
    dim = parts * max(1, -(-longest // parts))
    # bounded by the number of entries
    seeds = rows.where("vec_id IS NOT NULL").select("vec_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("vec_id", "vec").limit(entries).collect()
    first = np.array([np.pad(floors(np.array(r.vec, np.float64), scale), (0, dim - len(r.vec))) for r in seeds] or [np.zeros(dim)], np.int64)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    drift, sums, counts = np.zeros(books.shape[:2]), np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    table, scanned = rows, []
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((books, drift.ravel()))
        table = scratch.table(f"round{r}", table.mapInArrow(_pass(shared, dim, scale, r == 0), _BLOCKS_SQL))
        # at most entries x (components + 1) x parts rows
        moved = table.select(F.explode("delta").alias("d")).groupBy("d.slot", "d.place").agg(F.sum("d.sum").alias("sum")).collect()
        scanned.append(0)
        for m in moved:
            if m.slot < 0:
                scanned[-1] = int(m["sum"])
                continue
            p, e = divmod(m.slot, books.shape[1])
            if m.place < 0:
                counts[p, e] += int(m["sum"])
            else:
                sums[p, e, m.place] += int(m["sum"])
        new = updated(books, sums, counts)
        drift, books = drifted(drift, books, new), new
        if r:
            scratch.drop(f"round{r - 1}")
    shared = spark.sparkContext.broadcast((books, drift.ravel()))
    coded = scratch.table("codes", table.mapInArrow(_codes(shared), "vec_id bigint, label string, code string, error bigint"))
    by_label = scratch.table("labels", coded.groupBy("label").agg(long_sum(F.col("error")).alias("label_error")).withColumnRenamed("label", "of"), few=True)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.lit(",".join(map(str, scanned))).alias("scanned"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string, scanned string")


def _sql() -> str:
    n, k, scale = PARTS, ENTRIES, SCALE
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS given, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS (SELECT CAST({n} * greatest(1, ceil(max(len(v)) / {n}.0)) AS BIGINT) AS dim FROM v)",
        f"""x AS MATERIALIZED (SELECT rid, vec_id, given, p, list_transform(range(dim // {n}), lambda i: coalesce(v[p * (dim // {n}) + i + 1], 0)) AS x FROM v, w, (SELECT unnest(range({n})) AS p))""",
        f"""b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, given) - 1 AS e, x AS c FROM x WHERE vec_id IS NOT NULL QUALIFY e < {k})""",
    ]
    near = """a{r} AS MATERIALIZED (SELECT rid, p, d.e AS e, d.d AS d FROM (SELECT rid, x.p AS p, min({{'d': list_sum(list_transform(list_zip(x.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'e': b.e}}) AS d FROM x JOIN b{r} b ON x.p = b.p GROUP BY rid, x.p))"""
    for r in range(ROUNDS):
        steps += [
            near.format(r=r),
            f"""s{r} AS (SELECT p, e, i, CAST(sum(t) AS BIGINT) AS s, count(*) AS m FROM (SELECT a.p AS p, a.e AS e, unnest(x.x) AS t, unnest(range(len(x.x))) AS i FROM a{r} a JOIN x ON a.rid = x.rid AND a.p = x.p) GROUP BY p, e, i)""",
            f"""b{r + 1} AS MATERIALIZED (SELECT b.p AS p, b.e AS e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{r} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""",
        ]
    steps += [
        near.format(r=ROUNDS),
        f"z AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})",
        f"o AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (rid), z"


SQL = _sql()


def brute_force(rows: list[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[list[tuple], str]:
    """(vec_id, label, code, error) of the kept rows in plain Python's integers, and the digest of the codebooks; for tests."""
    import math

    kept = [(i, lab, [floor_of(c, scale) for c in v], [float(c) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = parts * max(1, -(-max((len(k[2]) for k in kept), default=0) // parts))
    w = dim // parts
    cut = [[(v + [0] * (dim - len(v)))[p * w : (p + 1) * w] for p in range(parts)] for _, _, v, _ in kept]
    seeds = sorted((kept[r][0], kept[r][3], r) for r in range(len(kept)) if kept[r][0] is not None)[:entries]
    books = [[cut[r][p] for *_, r in seeds] or [[0] * w] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[r][p] for r in range(len(cut)) if got[r][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, lab, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for (i, lab, *_), a in zip(kept, assign(), strict=True)], digest
