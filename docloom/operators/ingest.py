"""Ingest: documents to the chunk table, in one pass of split, analysis, classification and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.operators import analyze as an
from docloom.operators import enrich as en
from docloom.operators import split as sp


def chunk_table(docs: DataFrame, strategy: str = "stable", content: str = "text", rules: list[lx.Rule] | None = None, domains: dict = lx.DOMAINS, words: lx.Analyzer = lx.Analyzer(), **split_options) -> DataFrame:
    """A row for each chunk with its flat metadata; docs has doc_id and content. A chunk's id is its document's and its place in it."""
    chunks = sp.split(docs, strategy, content=content, **split_options)
    e = en.enrich(chunks, "text", rules, domains, words)
    a, c, x = F.col("analysis"), F.col("classification"), F.col("enrichment")
    keys = F.array_distinct(F.concat(a["keywords"], a["technical_terms"]))
    return e.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", F.col("text").alias("content"),
        a["content_type"].alias("content_type"), keys.alias("keywords"), a["has_steps"].alias("has_steps"), a["step_count"].alias("step_count"), a["n_words"].alias("word_count"), a["n_sentences"].alias("sentence_count"), F.length("text").alias("chunk_length"), a["confidence"].alias("confidence"),
        an.primary_language(a["language"], F.col("text")).alias("language"), c["primary"].alias("category"), c["secondary"].alias("secondary"), c["total"].alias("classification_confidence"), c["flags"].alias("flags"), c["rules"].alias("rules"),
        x["quality"].alias("quality"), x["safety"].alias("safety"), x["expertise"].alias("expertise"), x["domain"].alias("domain"), x["section"].alias("section"), x["search_boost"].alias("search_boost"), x["prerequisites"].alias("prerequisites"), x["filter_tags"].alias("filter_tags"), x["content_hash"].alias("content_hash"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet by category, so that a filter on it reads only its folders."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def processing_stats(chunks: DataFrame) -> DataFrame:
    """Of each category: chunks, documents, mean length, shares of quality levels."""
    share = lambda q: (F.sum((F.col("quality") == q).cast("long")) * 100.0 / F.count("*")).alias(f"{q}_percent")
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.avg("chunk_length").alias("avg_length"), share("excellent"), share("good"), share("moderate"), share("poor"))
