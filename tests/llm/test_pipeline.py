"""The pipeline's stages on one input each, and run() against a brute-force version."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from docloom.llm import decontam, langid, line_dedup, mixing, ngram_join  # noqa: E402
from docloom.llm.frames import table  # noqa: E402


def brute_force(spark, sf):
    """doc_id and text of each kept row with its number of copies."""
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    lang = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    rows = {r.doc_id: r for r in docs.collect() if lang[r.doc_id].lang_pred != "und" and lang[r.doc_id].score >= pipeline.MIN_LANGUAGE}
    stripped = zip(rows, line_dedup.brute_force([(d, r.text) for d, r in rows.items()]), strict=True)
    texts = {d: rows[d].text if n == k else t for d, (n, k, t) in stripped}
    comp = ngram_join.brute_force(list(texts.items()))
    texts = {d: t for d, t in texts.items() if comp[d][1] == d}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hit = decontam.brute_force(list(texts.values()), items)
    texts = {d: t for (d, t), h in zip(texts.items(), hit, strict=True) if not h[1]}
    left = spark.createDataFrame([(d, t, rows[d].source) for d, t in texts.items()], "doc_id long, text string, source string")
    return {(r.doc_id, texts[r.doc_id]): r.copies for r in mixing.plan(left).collect() if r.copies}


def test_run(spark, sf):
    got = pipeline.run(spark, sf)
    assert {(r.doc_id, r.text): r["count"] for r in got.groupBy("doc_id", "text").count().collect()} == brute_force(spark, sf)
    assert got.where(F.length("text") != F.col("n_chars")).count() == 0


def test_stages(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mix_sources"]
    docs = table(spark, sf, "documents")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "plain words of the text", "en", None, 3), (90001, "", "en", "s", 0)], docs.schema)).withColumn("score", F.lit(1)).withColumn("kept_id", F.lit(2))
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns[: len(odd.columns)] == odd.columns and out.count() > 0, name
        if name != "mix_sources":
            assert out.columns == odd.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
