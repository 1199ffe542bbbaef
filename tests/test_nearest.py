"""Tiled searches against all pairs by column expressions, on ties, zero, null and non-finite vectors."""

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import vector as vx
from docloom.operators import vectors
from docloom.operators.keyword import top_k


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(40, 6)), 1)
    rows = [(i, base[i % 40].tolist(), i % 3 if i % 7 else None) for i in range(200)]  # each five times
    rows += [(500, [0.0] * 6, 1), (501, [math.nan] * 6, 1), (502, [1.0], 1), (503, None, 2), (504, [1e300] * 6, 2), (505, [-1.0] * 6, 2), (506, [], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def asked(store):
    return store.where("vec_id % 20 = 0 OR vec_id BETWEEN 500 AND 503").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@pytest.mark.parametrize("metric", [*vx.METRICS, "signed"])
def test_tiles_give_what_all_pairs_give(spark, store, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    signed = metric == "signed"
    every = vectors.signed_scores(store, asked(store)).where("score IS NOT NULL") if signed else vectors.scores(store, asked(store), metric)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, repr(round(r.score, 9))) for r in df.collect())
    got = vectors.signed_knn(store, asked(store), 7) if signed else vectors.knn(store, asked(store), 7, metric)
    assert key(got) == key(top_k(every, 7, tie="vec_id"))


@pytest.mark.parametrize("metric", ["cosine", "angular"])
def test_a_zero_vectors_cosine_can_be_given(spark, store, metric):
    every = vectors.scores(store, asked(store), metric, zero=1.0)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, repr(round(r.score, 9))) for r in df.collect())
    got = vectors.knn(store, asked(store), 7, metric, zero=1.0)
    assert key(got) == key(top_k(every, 7, tie="vec_id"))
    assert {r.score for r in got.where("query_id = 500").collect()} == {1.0}


@pytest.mark.parametrize("metric", vx.METRICS)
def test_only_the_best_of_a_task_leave_it(metric):
    """Before, each Arrow batch gave its k best, so rows and memory grew with queries times batches."""
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(30, 8)), rng.normal(size=(5000, 8))
    found = vectors.Nearest(q, 4, metric)
    found.V, found.Q = 64, 8
    for a in range(0, 5000, 500):
        found.add(np.arange(a, a + 500), v[a : a + 500])
    rows = pa.Table.from_batches(found.rows(np.arange(30))).to_pandas()
    assert len(rows) == 120
    for i, mine in rows.groupby("q"):
        score, _ = vectors.exact(np.repeat(q[i : i + 1], 5000, axis=0), v, np.repeat(found.norm[i], 5000), vectors.norms_of(v), metric)
        assert mine["vec_id"].tolist() == np.lexsort((np.arange(5000), -score))[:4].tolist()


@pytest.mark.parametrize("how", ["mean", "max", "concat"])
def test_groups_without_rows_for_pairs(spark, store, monkeypatch, how):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    good = store.where("vec_id < 501")
    want = vectors.multi_vector(vectors.group_pairs(good, asked(good), "label"), how)
    key = lambda df: [(r.group_id, round(r.score, 9)) for r in sorted(df.collect(), key=lambda r: (r.group_id is None, r.group_id))]
    assert key(vectors.multi_vector_of(good, asked(good), "label", how)) == key(want)


def test_weights_end(spark):
    assert math.exp(-0.1 * vectors.WEIGHTLESS) == 0 and all(math.exp(-0.1 * a) >= math.exp(-0.1 * b) for a, b in pairwise(range(7400, vectors.WEIGHTLESS)))
