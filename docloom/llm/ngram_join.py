"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

A text's set is its distinct k-word shingles, as 64-bit hashes. Texts of equal sets are one class.
All sets are ordered alike, rare shingles first. For a set of n shingles and Jaccard t every
partner shares at least T = ceil(t n) of them, so two linked sets share at least min(l, l')
shingles among their first n - T + l and n' - T' + l'. Each document picks its l: a longer prefix
is read by more lists but asks for more matches. So l, a power of two, is that of the least
estimated cost |prefix| + n * sum(df) / l: what the prefix takes to deal out, and the tests of size n
of the partners expected to share l of it. Texts that share passages with many others ask for more.

Steps, each a map or a shuffle of evenly dealt blocks, never of all documents of one shingle as rows:
1. One pass over the texts: set sizes and fingerprints, and counts of locally repeated shingles,
   which add up to a table of fixed size that estimates frequency. It only sets the order.
2. Prefixes go to buckets by shingle, each a partition, packed, as 32 further bits of it (a clash only adds a candidate). In a bucket, the documents of one shingle whose sizes
   allow a partner are tied to one of them, the pivot: rows are linear in the prefixes, whatever the
   group. Documents with fewer shared prefix shingles than any partner asks for are dropped.
3. Pivots gather their documents, in blocks of bounded size (every two blocks of a large group meet), first
   as counts of their shingles in BINS bins: two sets share at most the sum of the smaller counts. Those for whom that leaves no
   partner go, so texts that met by chance, of which there are ever more, don't send their sets. Of the others the sets are gathered; each pair that is not yet connected passes size, multi-match and exact test; of the
   links that hold, those that connect something new are emitted. So copies never expand to pairs.
4. Components of the links, carried back to classes and documents.

Defined results: null and empty texts, and those without words, have size 0 and their own id as
component; fewer than k words make one shingle; a document without id is linked with nothing and
has no component; rows that share an id are linked as one document; repeated rows are one class;
sets of equally rare shingles are ordered by hash, which changes no result; a very long text is one
set, read whole and alone in its slice; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.frames import pick
from docloom.llm.scratch import Scratch
from docloom.llm.words import U64, Words, grow, mix, pack_rows, pieces, shingles, shrink, unpack_rows

#: Words of a shingle; Jaccard in percent; slots of the frequency table; largest l.
K, PERCENT, SLOTS, MULTI = 5, 75, 1 << 20, 1 << 14
#: Partners by chance that a shingle outside the frequency table is taken to have; rounds that drop hopeless candidates;
#: parts of a bucket, as a power of two, that are worked on one after another.
RARE, ROUNDS = 0.1, 3
PARTS_BITS = 4
#: Bins of a set's counts, and shingles from which a set has none and may match any of its size.
BINS, UNCOUNTED = 512, 1 << 22
#: Members up to which a pivot's candidates are looked at pair by pair.
SMALL = 16
#: Shingles counted together for the frequency table, and repeats in them that make a shingle count as common.
COUNTED, COMMON = 1 << 20, 3
#: Bytes of a packed block, prefix shingles of a bucket, shingles of a group's block and of a verifying task.
PACKED, BUCKET, GROUP, TASK = 4 << 20, 1 << 22, 1 << 20, 1 << 20


def need(n, percent: int = PERCENT):
    """The least number of shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal for equal sets."""
    a, b = mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _measure(k: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= COMMON], c[c >= COMMON]
            return _rows(slot=(u % U64(slots)).astype(np.int64), count=c.astype(np.int64))

        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingles(Words(piece.column(1), "spaced"), k)
                prints = [fingerprint(s) for s in sets]
                yield _rows(doc_id=piece.column(0), n=np.array([len(s) for s in sets]), f1=np.array([f[0] for f in prints]), f2=np.array([f[1] for f in prints]))
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield common()
                    held, size = [], 0
        if held:
            yield common()

    return run


_PASS1 = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "f1", "f2", "slot", "count")])


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols.get(f.name), pa.Array) else pa.array(c, pa.int64()) if c is not None else pa.nulls(n, pa.int64()) for f in _PASS1], schema=_PASS1)


class Order:
    """The common order of shingles and each set's choice of l."""

    def __init__(self, table: np.ndarray, percent: int, multi: int):
        self.table, self.percent, self.multi = table, percent, multi

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int, int, float]:
        """The set in order, its l, its prefix length, and how common its shingles are."""
        df = self.table[(s % U64(len(self.table))).astype(np.int64)]
        order = np.lexsort((s, df))
        d = df[order].astype(np.float64)
        n, t = len(s), int(need(len(s), self.percent))
        best, cost, l, cum = 1, math.inf, 1, np.cumsum(d + RARE)
        while l <= min(self.multi, t):
            x = min(n, n - t + l)
            if (c := x + n * cum[x - 1] / l) < cost:
                best, cost = l, c
            l *= 2
        return s[order], best, min(n, n - t + best), float((d > 0).mean())


_PACK = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary())])
_ENTRY = np.dtype([("c", "i8"), ("q", "f4"), ("n", "i4"), ("tokens", "i4"), ("l", "i2")])


def _prefixes(k: int, shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared.value
        parts: list[list[tuple]] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def pack() -> pa.RecordBatch:
            tok = np.concatenate([p[0] for p in parts])
            doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            b = ((tok >> U64(32)) % U64(buckets)).astype(np.int64)
            at = np.lexsort((doc, b))
            tok, doc, b = tok[at], doc[at], b[at]
            out = ([], [], [], [])
            edge = np.searchsorted(b, np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(edge)).tolist():
                d, n = np.unique(doc[edge[i] : edge[i + 1]], return_counts=True)
                e = np.zeros(len(d), _ENTRY)
                for f, j in (("c", 1), ("q", 2), ("n", 3), ("l", 4)):
                    e[f] = [parts[x][j] for x in d]
                e["tokens"] = n
                out[0].append(i)
                out[1].append(len(e))
                out[2].append(pack_rows(e))
                out[3].append(tok[edge[i] : edge[i + 1]].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _PACK, strict=True)], schema=_PACK)

        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc_id, s in zip(piece.column(0).to_pylist(), shingles(Words(piece.column(1), "spaced"), k), strict=True):
                    if doc_id is None or not len(s):
                        continue
                    f = fingerprint(s)
                    if f in seen:
                        continue
                    seen.add(f)
                    s, l, p, q = order(s)
                    parts.append((s[:p], f[0], q, len(s), l))
                    size += 4 * p + _ENTRY.itemsize
                    if size >= PACKED:
                        yield pack()
                        parts, size, seen = [], 0, set()
        if parts:
            yield pack()

    return run


_TIES = pa.schema([("p", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("least", pa.int64())])


def _pivots(percent: int):
    def run(table: pa.Table) -> pa.Table:
        e = np.concatenate([unpack_rows(b.as_buffer(), n.as_py(), _ENTRY) for b, n in zip(table["docs"], table["n"], strict=True)])
        tok = np.concatenate([np.frombuffer(b.as_buffer(), np.uint32) for b in table["tokens"]])
        cs, one, of = np.unique(e["c"], return_index=True, return_inverse=True)
        d = np.repeat(of.astype(np.uint32), e["tokens"])
        n, l, q = e["n"][one].astype(np.int64), e["l"][one].astype(np.int64), e["q"][one]
        rank = np.empty(len(cs), np.uint64)
        rank[np.lexsort((cs, -q))] = np.arange(len(cs), dtype=np.uint64)
        by_size = np.empty(len(cs), np.uint64)
        in_size = np.lexsort((cs, n))
        by_size[in_size] = np.arange(len(cs), dtype=np.uint64)

        def ties(tok: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pivot and member as one number, shared shingles, least l, of some of the bucket's shingles."""
            # once for each document and shingle, by size; then documents that some other of the shingle's can match in size
            key = np.unique((tok.astype(U64) << U64(32)) | by_size[d])
            tok, d = (key >> U64(32)).astype(np.uint32), in_size[(key & U64(0xFFFFFFFF)).view(np.int64)]
            near = (tok[1:] == tok[:-1]) & (100 * n[d[:-1]] >= percent * n[d[1:]]) if len(tok) else np.zeros(0, bool)
            keep = np.concatenate((near, [False])) | np.concatenate(([False], near)) if len(tok) else near
            tok, d = tok[keep], d[keep]
            if not len(tok):
                return (np.zeros(0, np.int64),) * 3
            at = np.argsort((tok.astype(U64) << U64(32)) | rank[d])
            tok, d = tok[at], d[at]
            first = np.concatenate(([True], tok[1:] != tok[:-1]))
            run_ = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            return summed(d[starts][run_] * len(cs) + d, np.ones(len(d), np.int64), np.minimum.reduceat(l[d], starts)[run_])

        def summed(key: np.ndarray, shared: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            u, inv = np.unique(key, return_inverse=True)
            low = np.full(len(u), 1 << 30, np.int64)
            np.minimum.at(low, inv, least)
            return u, np.bincount(inv, shared, len(u)).astype(np.int64), low

        part = tok >> np.uint32(32 - PARTS_BITS)  # a part of the shingles at a time bounds what a worker holds
        each = [ties(tok[m], d[m]) for m in (part == i for i in range(1 << PARTS_BITS))]
        u, cnt, low = summed(*(np.concatenate(x) for x in zip(*each, strict=True)))
        p, c = u // len(cs), u % len(cs)
        return pa.table([cs[p], cs[c], n[c], cnt, low], schema=_TIES)

    return run


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("l", pa.int64()), ("prefix", pa.int64()), ("grams", pa.binary()), ("flags", pa.binary())])


def _sets(k: int, shared, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wanted = shared.value, bits.value
        for batch in batches:
            slot = np.array(batch.column(2))
            batch = batch.filter(pa.array((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for piece in pieces(batch, "text"):
                out = ([], [], [], [], [], [])
                for doc_id, s in zip(piece.column(0).to_pylist(), shingles(Words(piece.column(1), "spaced"), k), strict=True):
                    if len(s):
                        ordered, l, p, _ = order(s)
                        for o, x in zip(out, (doc_id, len(s), l, p, *pack_set(s, ordered[:p])), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _SETS, strict=True)], schema=_SETS)

    return run


def pack_set(s: np.ndarray, prefix: np.ndarray) -> tuple[bytes, bytes]:
    """48 bits of each shingle of a sorted set, as differences, and which of them are in the prefix.

    Two sets of n chance on a common value with probability n * n / 2**48.
    """
    return shrink(np.diff(s >> U64(16), prepend=U64(0))), np.packbits(np.isin(s, prefix, assume_unique=True)).tobytes()


def unpack_set(grams, flags) -> np.ndarray:
    """The set again, its prefix first."""
    s = np.cumsum(grow(grams))
    first = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(s)).astype(bool)
    return np.concatenate((s[first], s[~first]))


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def link_group(sets: list[np.ndarray], l: np.ndarray, prefix: np.ndarray, side: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect the group: every pair not yet connected is tested. across: only pairs of different sides."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        a, b = sets
        if (across and side[0] == side[1]) or 100 * n.min() < percent * n.max():
            return []
        if np.isin(a[: prefix[0]], b[: prefix[1]], assume_unique=True).sum() < l.min():
            return []
        both = int(np.isin(a, b, assume_unique=True).sum())
        return [(0, 1)] if 100 * both >= percent * int(n.sum() - both) else []
    tok = np.concatenate(sets)
    doc = np.repeat(np.arange(m), n)
    pre = np.concatenate([np.arange(x) < p for x, p in zip(n, prefix, strict=True)])
    _, inv = np.unique(tok, return_inverse=True)
    at = np.argsort(inv, kind="stable")
    lists, starts = doc[at], np.concatenate(([0], np.cumsum(np.bincount(inv))))
    at_pre = at[pre[at]]
    lists_pre, starts_pre = doc[at_pre], np.concatenate(([0], np.cumsum(np.bincount(inv[at_pre], minlength=len(starts) - 1))))
    ends = np.concatenate(([0], np.cumsum(n)))

    def shared(x: int, upto: int, ls: np.ndarray, st: np.ndarray) -> np.ndarray:
        t = inv[ends[x] : ends[x] + upto]
        a, z = st[t], st[t + 1]
        w = z - a
        return np.bincount(ls[np.repeat(a - (np.cumsum(w) - w), w) + np.arange(w.sum())], minlength=m)

    sets_of, out = Union(m), []
    # the pivot is first; then those that stay apart, each against all that it isn't connected with
    for x in range(m):
        root = sets_of.roots()
        cand = (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if across:
            cand &= side != side[x]
        if not cand.any():
            continue
        cand &= shared(x, int(prefix[x]), lists_pre, starts_pre) >= np.minimum(l, l[x])
        if not cand.any():
            continue
        both = shared(x, int(n[x]), lists, starts)
        for y in np.flatnonzero(cand & (100 * both >= percent * (n + n[x] - both))).tolist():
            if sets_of.join(x, y):
                out.append((x, y))
    return out


_MEMBER = ("p", "i", "j", "side", "is_pivot", "doc_id", "grams_n")


def binned(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by bin, low bytes first, of the bits that sets are compared by; empty for a very large set."""
    if len(s) >= UNCOUNTED:
        return b""
    return np.bincount(((s >> U64(16)) % U64(BINS)).astype(np.int64), minlength=BINS).astype("<u2").view(np.uint8).reshape(BINS, 2).T.tobytes()


def unbinned(raw: bytes) -> np.ndarray:
    """The counts again; of a very large set more than any other has."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, BINS).T).view("<u2").ravel() if raw else np.full(BINS, (1 << 16) - 1, "<u2")


def hopeful(counts: np.ndarray, n: np.ndarray, side: np.ndarray, across: bool, percent: int) -> np.ndarray:
    """Which of a group's members may have a partner in it, by size and counts. across: only pairs of different sides."""
    keep, open_ = np.zeros(len(n), bool), counts[:, 0] == (1 << 16) - 1
    for x in range(len(n)):
        cand = (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])) & ~(keep & keep[x])
        cand[x] = False
        if across:
            cand &= side != side[x]
        y = np.flatnonzero(cand)
        for at in range(0, len(y), 1024):
            some = y[at : at + 1024]
            both = np.minimum(counts[x], counts[some]).sum(axis=1, dtype=np.int64)
            some = some[open_[x] | open_[some] | (100 * both >= percent * (n[x] + n[some] - both))]
            keep[some] = True
            keep[x] |= len(some) > 0
    return keep


def _sketches(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for batch in batches:
            slot = np.array(batch.column(2))
            batch = batch.filter(pa.array((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for piece in pieces(batch, "text"):
                found = [(d, binned(s)) for d, s in zip(piece.column(0).to_pylist(), shingles(Words(piece.column(1), "spaced"), k), strict=True) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], names=["doc_id", "bins"])

    return run


def _hopeful(percent: int):
    def run(table: pa.Table) -> pa.Table:
        p, i, j, side, doc, n = (np.array(table[c]) for c in ("p", "i", "j", "side", "doc_id", "grams_n"))
        bins = table["bins"].combine_chunks()
        order = np.lexsort((doc, ~np.array(table["is_pivot"]), j, i, p))
        key = np.stack([p[order], i[order], j[order]])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]))
        kept = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            rows = order[s:e]
            if len(rows) > 1:
                counts = np.stack([unbinned(bins[int(r)].as_py()) for r in rows])
                kept.append(rows[hopeful(counts, n[rows], side[rows], i[rows[0]] != j[rows[0]], percent)])
        return table.select(_MEMBER).take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        p, i, j, side, doc, l, pre, first = (np.array(table[c]) for c in ("p", "i", "j", "side", "doc_id", "l", "prefix", "is_pivot"))
        grams, flags = table["grams"], table["flags"]
        order = np.lexsort((doc, ~first, j, i, p))
        key = np.stack([p[order], i[order], j[order]])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]))
        a, b = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            rows = order[s:e]
            if len(rows) > 1:
                sets = [unpack_set(grams[int(r)].as_buffer(), flags[int(r)].as_buffer()) for r in rows]
                for x, y in link_group(sets, l[rows], pre[rows], side[rows], i[rows[0]] != j[rows[0]], percent):
                    a.append(doc[rows[x]])
                    b.append(doc[rows[y]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    return run


def candidates(sized: DataFrame, percent: int = PERCENT) -> DataFrame:
    """p, c: the members to test under each pivot, from ties (p, c, n, shared, least) with m, the pivot's members.

    A linked pair shares its shingles under at most as many pivots as either has, so under one of them at least the mean. Where
    that is a large group, each of the two has the mean there; where it is a small one, the pair has. A pair of which one is in
    small groups only needs to share all that is asked for there.
    """
    big = (F.col("m") > SMALL).cast("int")
    each = sized.groupBy("c").agg(F.count("*").alias("k"), F.sum(big).alias("k_large"), F.min("least").alias("low"))
    held = sized.join(each, "c")
    # in small groups, pair by pair; a pair that stays is tested under the pivot where it shares most
    x = held.where(F.col("m") <= SMALL).select("p", "c", "n", "shared", "least", "k", "k_large")
    y = x.select("p", *(F.col(v).alias(f"{v}2") for v in ("c", "n", "shared", "least", "k", "k_large")))
    pairs = x.join(y, "p").where((F.col("c") < F.col("c2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    both = F.least("shared", "shared2")
    k = F.when(F.least("k_large", "k_large2") > 0, F.least("k", "k2")).otherwise(0)
    pairs = pairs.groupBy("c", "c2").agg(F.sum(both).alias("s"), F.max(both).alias("best"), F.max(k).alias("k"), F.min(F.least("least", "least2")).alias("l"), F.max(F.struct(both.alias("b"), "p"))["p"].alias("p"))
    small = pairs.where("s >= l OR best * k >= l").select("p", F.explode(F.array("c", "c2")).alias("c")).distinct()
    large = held.where((F.col("m") > SMALL) & (F.col("shared") * F.col("k") >= F.col("low"))).select("p", "c")
    return small.unionByName(large)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT, multi: int = MULTI, slots: int = SLOTS, group: int = GROUP, task: int = TASK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    first = scratch.table("sizes", docs.mapInArrow(_measure(k, slots), "doc_id long, n long, f1 long, f2 long, slot long, count long"))
    sizes = first.where("slot IS NULL").select("doc_id", "n", "f1", "f2")
    table = np.zeros(slots, np.int64)
    common = first.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()  # at most `slots` rows
    table[np.array(common["slot"])] = np.array(common["count"])
    shared = spark.sparkContext.broadcast(Order(np.minimum(table, np.iinfo(np.int32).max).astype(np.int32), percent, multi))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    classes = sizes.where("doc_id IS NOT NULL AND n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))

    buckets = max(8, total // (3 * BUCKET))
    packed = docs.mapInArrow(_prefixes(k, shared, buckets), "bucket int, n int, docs binary, tokens binary")
    ties = packed.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_pivots(percent), "p long, c long, n long, shared long, least long")
    ties = scratch.table("ties", ties.groupBy("p", "c").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.min("least").alias("least")), few=True)
    for r in range(ROUNDS):  # fewer shared shingles, over all its pivots, than any partner asks for; then pivots left alone
        enough = ties.groupBy("c").agg(F.sum("shared").alias("s"), F.min("least").alias("m")).where("s >= m").select("c")
        ties = ties.join(enough, "c")
        ties = scratch.table(f"ties{r}", ties.join(ties.groupBy("p").agg(F.count("*").alias("m")).where("m > 1").select("p"), "p"), few=True)
        scratch.drop("ties" if not r else f"ties{r - 1}")
    sized = scratch.table("sized", ties.join(ties.groupBy("p").agg(F.count("*").alias("m")), "p"), few=True)
    scratch.drop(f"ties{ROUNDS - 1}")
    ties = scratch.table("kept", candidates(sized, percent), few=True)
    ties = ties.select("p", "c").join(classes.select(F.col("f1").alias("c"), "n", "rep"), "c")
    groups = ties.groupBy("p").agg(F.sum("n").alias("grams"))
    blocks = F.ceil(F.col("grams") / F.lit(group)).cast("int")
    ties = ties.join(groups.select("p", blocks.alias("blocks")), "p").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    ties = ties.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = scratch.table("members", ties.select("p", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", (F.col("p") == F.col("c")).alias("is_pivot"), F.col("rep").alias("doc_id"), F.col("n").alias("grams_n")), few=True)
    scratch.drop("sized", "kept")

    def texts_of(rows: DataFrame) -> tuple[DataFrame, object]:
        """doc_id, text, slot of all documents, and the bitmap of the slots that those of rows have."""
        wanted = rows.select("doc_id").distinct()
        size = 1 << max(18, min(28, (64 * wanted.count()).bit_length()))
        slot = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(size))
        # bitmap functions number the bits of a bucket from 1
        marks = wanted.select((slot() + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        bits = np.zeros(size // 8 + 4096, np.uint8)
        for r in marks.collect():  # at most 2**28 bits, in pieces of 4 KB
            bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
        return docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot().alias("slot")), spark.sparkContext.broadcast(bits)

    texts, bits = texts_of(members)
    tasks = max(8, members.count() * BINS // task)
    counted = members.join(texts.mapInArrow(_sketches(k, bits), "doc_id long, bins binary"), "doc_id").withColumn("task", F.pmod(F.xxhash64("p", "i", "j"), F.lit(tasks)).cast("int"))
    members = scratch.table("hopeful", counted.select("task", *_MEMBER, "bins").repartitionById(tasks, "task").groupBy("task").applyInArrow(_hopeful(percent), members.select(*_MEMBER).schema), few=True)
    scratch.drop("members")

    texts, bits = texts_of(members)
    sets = texts.mapInArrow(_sets(k, shared, bits), "doc_id long, n long, l long, prefix long, grams binary, flags binary")
    todo = members.agg(F.coalesce(F.sum("grams_n"), F.lit(0)).alias("n")).first().n
    tasks = max(8, todo // task)
    dealt = members.join(sets, "doc_id").withColumn("task", F.pmod(F.xxhash64("p", "i", "j"), F.lit(tasks)).cast("int"))
    links = scratch.table("links", dealt.select("task", "p", "i", "j", "side", "is_pivot", "doc_id", "l", "prefix", "grams", "flags").repartitionById(tasks, "task").groupBy("task").applyInArrow(_verify(percent), "a long, b long"))
    scratch.drop("hopeful")
    found = components(links, scratch)
    # written, so that the join below has nothing but exchanges under it and a large group of copies can be split
    named = scratch.table("named", classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component")), few=True)
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")) & F.col("doc_id").isNotNull()
    return sizes.join(named, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
l AS (SELECT rid, i, n, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM t),
s AS MATERIALIZED (SELECT DISTINCT rid, hash(l) AS h, l FROM l WHERE len(l) = 5 OR (n < 5 AND i = 1)),
c AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.l = b.l AND a.rid < b.rid GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN c a ON a.rid = x JOIN c b ON b.rid = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
g AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rid AS a, rid AS z FROM d UNION SELECT r.a, g.y FROM r JOIN g ON g.x = r.z)
SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN c USING (rid) JOIN r ON r.a = d.rid JOIN d o ON o.rid = r.z GROUP BY d.rid, d.doc_id
"""


def brute_force(rows: list[tuple], k: int = K, percent: int = PERCENT) -> dict:
    """doc_id to (n_shingles, component_id) by testing all pairs, for tests."""
    import re

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(d, grams(t)) for d, t in rows]
    links = Union(len(sets))
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                links.join(x, y)
    low: dict[int, int] = {}
    for x, (d, _) in enumerate(sets):
        r = links.find(x)
        low[r] = min(low.get(r, d), d)
    return {d: (len(s), low[links.find(x)]) for x, (d, s) in enumerate(sets)}
