"""The training-corpus pipeline: five stages over the documents table.

Each stage takes all that its predecessor kept, acts on it and hands on the columns of documents;
the last also numbers the copies it makes. run() writes every stage as Parquet in the shared folder
and reads it back as the next one's input, so a lost executor costs tasks of one stage.

Defined results: null, empty and wordless texts are `und` and go in the first stage, whatever their
other columns; null ids, sources and languages are kept, and rows without an id are documents of their
own, which no near-duplicate removes; repeated rows are near-duplicates of each other, so one stays; of
equally small ids the row of smallest hash stays; very long texts go through every stage whole; an empty
table stays empty; further columns are carried along whatever their names, and `copy` gives way to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, line_dedup, mixing, ngram_join
from docloom.llm.frames import fresh, table
from docloom.llm.scratch import Scratch, scope
from docloom.session import ship

#: Mean probability of its own language below which a document is rejected.
MIN_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of one language: not `und`, and labelled so by at least MIN_LANGUAGE of the words' probability."""
    ship(spark)
    marked, name = langid.mark(docs, langid.train(docs))
    return marked.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= MIN_LANGUAGE)).drop(name)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines from texts; n_chars follows the text. A document made of nothing else stays whole: the next stage keeps one of its copies."""
    ship(spark)
    out, lines, dropped = line_dedup.strip(docs.withColumn(whole := fresh(docs, "whole_text"), F.col("text")))
    left = F.when((F.col(lines) > 0) & (F.col(dropped) == F.col(lines)), F.col(whole)).otherwise(F.col("text"))
    out = out.withColumn("text", left.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one of smallest id, once (by hash, of rows that share it); documents without id stay.

    Which rows stay is settled on ids and hashes; texts move once, to a semi join that can be split by key.
    """
    ship(spark)
    found = ngram_join.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    print_ = F.xxhash64(*docs.columns)
    rows = docs.where("doc_id IS NOT NULL").groupBy("doc_id", print_.alias("print")).agg(F.count("*").alias("n"))
    first = rows.groupBy("doc_id").agg(F.min(F.struct("print", "n")).alias("x")).select("doc_id", "x.print", "x.n")
    key, print_key = fresh(docs, "kept_id"), fresh(docs, "kept_print")
    kept = first.join(found, "doc_id", "left_semi").select(F.col("doc_id").alias(key), F.col("print").alias(print_key), "n")
    same = (F.col("doc_id") == F.col(key)) & (print_ == F.col(print_key))
    once, repeated = docs.join(kept.where("n = 1"), same, "left_semi"), docs.join(kept.where("n > 1"), same, "left_semi")
    return once.unionByName(repeated.dropDuplicates()).unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item stands."""
    ship(spark)
    marked, name = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.col(name)["n_hit"] == 0).drop(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their targets; `copy` numbers the copies."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_templates),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
]

#: Language identification and line deduplication are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus from the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scope():  # the tables of the stage's operator go as soon as its result is written
            docs = scratch.table(name, stage(spark, docs, sf_dir))
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
