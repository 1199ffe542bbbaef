"""Texts are prepared as before by fewer steps."""

from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import index
from docloom.plans import defaults
from docloom.tables import Tables


def test_swaps_are_the_regexes(spark):
    texts = [None, "", "sps", "SPS und Sps-hmi", "ſps spsx I/O i/o", "ı/o İ/o dı aİ", "3 mm 4m 5 °C 6 °c ∕ mm", "cpu,ram rom\nplc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = F.col("t")
    for a, full in lx.ACRONYMS.items():
        want = F.regexp_replace(want, tx._edge(rf"\b{tx.quote(a)}\b"), f"{a} {full}")
    rows = df.select(want.alias("w"), tx.expand_acronyms(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [r.w for r in rows]


def test_modes_share_their_steps(spark):
    """Before, each mode expanded and normalised all texts anew."""
    texts = [None, "", "Die SPS-Steuerung 2,5 bar, 3 mm", "Speichersteuerungen der Pumpen\n human machine  interface i/o 5°c", "12,34,56 aİ ſps"]
    df = tx.in_all_modes(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bar druck") == 1
    for r in df.withColumns({f"{m}_alone": tx.preprocess(F.col("text"), m) for m in tx.PREPROCESSING}).collect():
        assert all(r[m] == r[f"{m}_alone"] for m in tx.PREPROCESSING)


def test_an_index_prepares_texts_once(spark):
    """Before, postings, frequencies, lengths and numbers each prepared all texts."""
    ix = index.build(spark.createDataFrame([(1, "Motor und Pumpe"), (2, "Motor")], "doc_id long, text string"), tables=Tables(spark, "words"))
    for t in (ix.postings, ix.frequencies(), ix.lengths, ix.numbers):
        assert "regexp" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {r.term: r.df for r in ix.frequencies().collect()} == {r.term: r.df for r in index.build(spark.createDataFrame([(1, "Motor und Pumpe"), (2, "Motor")], "doc_id long, text string")).frequencies().collect()}


def test_each_word_is_looked_up_once(spark):
    df = defaults.derived(spark.createDataFrame([("The  license\tOF x", ), (None,), ("",)], "text string"))
    assert "CASE WHEN" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in df.collect()] == ["Motor Installation SPS x", None, ""]
