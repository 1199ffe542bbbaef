"""Vector operators in integers: codes, inner-product search and clusters, against brute force in plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import dot_search, integers, lloyd, queries, vector_codes
from tests.oracle import compare, connection

VECTORS = "vec_id long, embedding array<double>, label int"
CLASH = {c: 1 for c in ("cluster", "distance", "code", "error", "label_error", "rank", "score", "query_id", "q", "copies", "same", "place", "pack", "vec", "id", "of", "delta", "slot", "inertia")}
NAN, INF = float("nan"), float("inf")


def drawn(n, dim, seed, spread=0.2, zeros=0.0, centres=5):
    """Vectors around a few centres, some components zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return np.where(rng.random(x.shape) < zeros, 0.0, x).round(4).tolist()


def edge_rows(dim):
    """Nulls everywhere, components that are null or not finite, other lengths, repeated rows, shared ids, ties, extreme values, in no order."""
    v = drawn(60, dim, 5)
    rows = [(i, x, i % 3) for i, x in enumerate(v)]
    rows += [(100, None, 1), (101, [None, *v[0][1:]], 1), (102, [NAN, *v[0][1:]], 1), (103, [*v[0][1:], -INF], None), (104, [], 1), (105, v[3][: dim - 1], None), (106, v[4] + v[5] + [1.0], 2)]
    rows += [(7, v[7], 7 % 3), (7, v[7], 7 % 3), (8, v[9], 2), (200, v[10], None), (201, v[10], None), (0, v[1], 5), (0, v[0], 0), (None, v[11], 0), (None, None, None), (300, [0.0] * dim, 1), (-100, v[12], 4), (-40, [-0.0] * dim, 4)]
    rows += [(400, [2.0**50] + [0.5] * (dim - 1), 1), (401, [-(2.0**50)] * dim, 1), (500, [1e300] * dim, None)]
    random.Random(2).shuffle(rows)
    return rows


def counted(rows):
    return Counter(map(tuple, rows))


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, VECTORS).repartition(parts).withColumns({k: F.lit(v) for k, v in CLASH.items()})


def coded(df, **more):
    got = vector_codes.compress(df, **more).collect()
    return counted((r.vec_id, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}, {r.scanned for r in got}


def coded_by_hand(rows, **more):
    got, digest = vector_codes.brute_force([(i, lab, v) for i, v, lab in rows], **more)
    by_label = {}
    for _, lab, _, e in got:
        by_label[lab] = by_label.get(lab, 0) + min(e, integers.LONG)
    return counted((i, c, min(e, integers.LONG), min(by_label[lab], integers.LONG)) for i, lab, c, e in got), {digest}


def test_exact_arithmetic():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 24, 1 << 31, 1 << 40, 1 << 61):
        x, y = rng.integers(-top, top, size=(7, 5)), rng.integers(-top, top, size=(4, 5))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in y] for r in x]
        assert integers.squares(x, y).tolist() == want and lloyd.distances(x, y).tolist() == want
        group = np.array([3, 0, 3, 0, 3, 9, 9])
        at, sums, n = integers.group_sums(x, group)
        assert at.tolist() == [0, 3, 9] and n.tolist() == [2, 3, 2] and sums.tolist() == [[sum(int(v) for v in x[group == g, c]) for c in range(5)] for g in (0, 3, 9)]
        assert [int(d.as_py()) for d in integers.decimals(sums.ravel())] == sums.ravel().tolist()
    col = pa.array([[1.5, -0.001], [], [2.0]], pa.list_(pa.float64()))
    assert integers.matrix(col, 3, 1024).tolist() == [[1536, -2, 0], [0, 0, 0], [2048, 0, 0]]


# 11


def test_heaps_give_up_all_violated_parts_and_no_others():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, heaps = int(rng.integers(1, 200)), 8
        block = vector_codes.Block(np.zeros((n, 1, 2), np.int64), heaps)
        heap = np.sort(rng.integers(heaps, size=n))
        block.size, block.item, block.key = np.bincount(heap, minlength=heaps), rng.permutation(n), rng.integers(20, size=n).astype(float)
        for h in range(heaps):  # any order of a run that is a heap will do
            run = np.flatnonzero(heap == h)
            block.key[run] = np.sort(block.key[run])
        drift = rng.integers(20, size=heaps).astype(float)
        assert sorted(block.popped(drift)) == np.flatnonzero(block.key <= drift[heap]).tolist()


@pytest.mark.parametrize("zeros", [0.0, 0.7])
def test_codes_against_brute_force(spark, zeros):
    rows = [(i * 3, v, i % 4) for i, v in enumerate(drawn(400, 8, 11, zeros=zeros))]
    want = coded_by_hand(rows, entries=12)
    for parts in (1, 5):
        assert coded(frame(spark, rows, parts), entries=12)[:2] == want
    assert coded(frame(spark, rows), entries=12, rounds=1)[:2] == coded_by_hand(rows, entries=12, rounds=1)


def test_codes_of_any_block_size(spark, monkeypatch):
    rows = [(i, v, None) for i, v in enumerate(drawn(150, 8, 12))]
    want = coded_by_hand(rows, entries=9)
    monkeypatch.setattr(vector_codes, "BLOCK", 8 * 7)
    monkeypatch.setattr(vector_codes, "ROWS", 3)
    got = list(vector_codes._gathered(iter([pa.RecordBatch.from_arrays([pa.array(range(20)), pa.nulls(20, pa.string()), pa.array([[0.5] * 8] * 20)], names=["i", "l", "v"])] * 2), 8, 4, 1024, 36))
    assert [len(b.x) for *_, b in got] == [7, 7, 6, 7, 7, 6]
    assert coded(frame(spark, rows, 2), entries=9)[:2] == want


def test_settled_parts_are_not_rescanned(spark):
    """Far groups whose entries stop moving: nothing is looked at again."""
    rng = np.random.default_rng(4)
    rows = [(i, ([10.0 * (i % 4)] * 8 + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(400)]
    got, digest, scanned = coded(frame(spark, rows), entries=4)
    assert (got, digest) == coded_by_hand(rows, entries=4)
    each = [int(n) for n in scanned.pop().split(",")]
    assert each[0] == 1600 and each[1:] == [0, 0, 0]
    many = [(i, v, 0) for i, v in enumerate(drawn(600, 8, 6, spread=0.05))]
    assert [int(n) for n in coded(frame(spark, many), entries=30)[2].pop().split(",")][-1] < 2400


def test_codes_on_edges(spark):
    for dim, entries in ((8, 256), (3, 7)):
        rows = edge_rows(dim)
        got = coded(frame(spark, rows), entries=entries)
        assert got[:2] == coded_by_hand(rows, entries=entries)
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [NAN], 1)])).count() == 0
    for rows in ([(1, [], 1)], [(None, [1.0, 2.0], None)], [(5, [1.0] * 9, 0)]):
        assert coded(frame(spark, rows))[:2] == coded_by_hand(rows)


# 12


@pytest.mark.parametrize("zeros", [0.0, 0.9])
def test_search_against_brute_force(spark, zeros):
    rows = [(i * 5, v, 0) for i, v in enumerate(drawn(300, 12, 21, zeros=zeros))]
    want = counted(dot_search.brute_force([r[:2] for r in rows], k=4, every=10))
    for parts, pack in ((1, 1 << 20), (4, 12 * 7)):
        assert counted(dot_search.top_k(frame(spark, rows, parts), k=4, every=10, pack=pack).collect()) == want


def test_postings_of_both_kinds():
    rng = np.random.default_rng(8)
    x = rng.integers(-5, 6, size=(50, 6)) * (rng.random((50, 6)) < [0.02, 0.1, 0.2, 0.5, 1, 0])
    posting = dot_search.Postings(x, np.int64)
    assert {r is None for r in posting.rows} == {True, False}
    q = rng.integers(-5, 6, size=9)  # terms that no posting has count nothing
    assert posting.score(np.flatnonzero(q), q[q != 0], np.ones(50, np.int64), np.zeros(50, np.int64)).tolist() == (x @ q[:6]).tolist()


def test_search_on_edges(spark, monkeypatch):
    for k, every in ((10, 10), (100, 40)):
        rows = edge_rows(6)
        want = counted(dot_search.brute_force([r[:2] for r in rows], k=k, every=every))
        assert want and counted(dot_search.top_k(frame(spark, rows), k=k, every=every, pack=40).collect()) == want
    monkeypatch.setattr(dot_search, "SLICE", 4)
    same = [(i // 2, [1.0, 2.0], 0) for i in range(60)]  # ties, every row twice
    assert counted(dot_search.top_k(frame(spark, same), every=10).collect()) == counted(dot_search.brute_force([r[:2] for r in same], every=10))
    for rows in ([], [(1, [1.0], 0)], [(100, None, 0)], [(100, [1.0], 0)]):
        assert dot_search.top_k(frame(spark, rows)).count() == 0


# 13


def test_clusters_against_brute_force(spark):
    rows = [(i * 7, v, 0) for i, v in enumerate(drawn(300, 6, 31))]
    for parts in (1, 4):
        assert counted(lloyd.cluster(frame(spark, rows, parts), clusters=9, dim=6).collect()) == counted(lloyd.brute_force([r[:2] for r in rows], clusters=9, dim=6))


def test_clusters_on_edges(spark):
    for clusters in (5, 200):
        rows = edge_rows(6)
        want = [(*r[:2], *(min(x, integers.LONG) for x in r[2:5]), r[5]) for r in lloyd.brute_force([r[:2] for r in rows], clusters=clusters, dim=6)]
        assert counted(lloyd.cluster(frame(spark, rows), clusters=clusters, dim=6).collect()) == counted(want)
    tied = [(i, [1.0, 2.0], 0) for i in range(30)] + [(2**60 + 1, [5.0, 2.0], 0), (None, [4.9, 2.0], 0)]
    assert counted(lloyd.cluster(frame(spark, tied), clusters=4, dim=2).collect()) == counted(lloyd.brute_force([r[:2] for r in tied], clusters=4, dim=2))
    for rows in ([], [(1, None, 0)], [(1, [1.0], 0)]):
        assert lloyd.cluster(frame(spark, rows)).count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_dot_topk", "op13_lloyd_clusters"])
def test_queries_against_sql(spark, sf, name):
    compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connection(sf))
