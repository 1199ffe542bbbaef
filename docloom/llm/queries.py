"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    chat_format,
    decontam,
    dot_search,
    embed_dedup,
    langid,
    license_scan,
    line_dedup,
    lloyd,
    lm_score,
    mixing,
    ngram_join,
    quality,
    vector_codes,
)
from docloom.llm.frames import table
from docloom.session import ship


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_hostile(table(spark, sf_dir, "conversations"), spark)
    return chat_format.read_back(chat_format.examples(turns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    # by the counts of all other documents: in those of the whole corpus every text vouches for itself, which hides the copies
    return lm_score.score(table(spark, sf_dir, "documents"), leave_out=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("scanned")


def op12_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dot_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_embedding_dedup, op3_ngram_join, op4_chat_format, op5_mix_sources, op6_lm_score, op7_quality, op8_license_scan, op9_decontaminate, op10_line_dedup, op11_vector_codes, op12_dot_topk, op13_lloyd_clusters)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": embed_dedup.SQL, "op3_ngram_join": ngram_join.SQL, "op4_chat_format": chat_format.SQL, "op5_mix_sources": mixing.SQL, "op9_decontaminate": decontam.SQL, "op11_vector_codes": vector_codes.SQL, "op12_dot_topk": dot_search.SQL, "op13_lloyd_clusters": lloyd.SQL}
