"""Inverted index as tables: postings (term, doc_id, tf), document lengths, document frequencies and corpus numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.tables import Tables


@dataclass(frozen=True)
class Index:
    """postings: term, doc_id, tf. lengths: doc_id, dl, technical. numbers: one row of n, avgdl, mindl, maxdl. counted: term, df, where they are known without the postings."""

    postings: DataFrame
    lengths: DataFrame
    numbers: DataFrame
    counted: DataFrame | None = None

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df; of the given terms (column term) only, if given: the filter reaches the postings before they are counted."""
        p = self.postings if self.counted is None else self.counted
        p = p if terms is None else p.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        return p.groupBy("term").agg(F.count("*").alias("df")) if self.counted is None else p


def build(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", mode: str | None = "industrial", least: int = 2, technical: Column | None = None, tables: Tables | None = None) -> Index:
    """Index of docs; mode None takes the words of the lower-cased text as they are. One shuffle, by term and document.

    tables: where the documents' words are written, so that texts are prepared once, not for postings, frequencies, lengths and numbers anew.
    """
    text = F.lower(F.col(content)) if mode is None else tx.preprocess(F.col(content), mode)
    flag = F.lit(False) if technical is None else technical
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tx.tokens(text, least), F.array().cast("array<string>")).alias("terms"), flag.alias("technical"))
    base = base if tables is None else tables.write("words", base)
    postings = base.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    lengths = base.select("doc_id", F.size("terms").cast("long").alias("dl"), "technical")
    return Index(postings, lengths, numbered(lengths))


def store(index: Index, path: str) -> Index:
    """Writes the index, a term's postings together and sorted so that a query's filter skips row groups, and returns it as read back."""
    spark = index.postings.sparkSession
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    numbered(spark.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/numbers")
    return load(spark, path)


def numbered(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.min("dl").alias("mindl"), F.max("dl").alias("maxdl"))


def load(spark, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "numbers")))


def statistics(index: Index, top: int = 10) -> DataFrame:
    """Terms, documents, lengths, and the most frequent terms with their document frequencies."""
    df = index.frequencies()
    best = df.orderBy(F.desc("df"), "term").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("o"), "term", "df"))), lambda x: F.concat(x["term"], F.lit("="), x["df"].cast("string"))), ", ").alias("top_terms"))
    return df.agg(F.count("*").alias("n_terms")).crossJoin(index.numbers).crossJoin(best)


def completions(index: Index, prefix: str, most: int = 10) -> DataFrame:
    """Terms that start with the prefix, the most frequent first."""
    return index.frequencies().where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("df"), "term").limit(most)


def suggestions(index: Index, history: DataFrame, partial: str, most: int = 5) -> DataFrame:
    """Terms with the prefix and past queries (column query) that contain it; by document frequency (0 for queries), then text."""
    terms = index.frequencies().where(F.col("term").startswith(partial.lower())).select(F.col("term").alias("suggestion"), "df")
    past = history.where(F.contains(F.lower("query"), F.lit(partial.lower()))).select(F.col("query").alias("suggestion"), F.lit(0).cast("long").alias("df"))
    return terms.unionByName(past).groupBy("suggestion").agg(F.max("df").alias("df")).orderBy(F.desc("df"), "suggestion").limit(most)


def query_profile(index: Index, terms: DataFrame, rare: int = 5, common: float = 0.1) -> DataFrame:
    """Of each query (query_id, term): unknown, rare and common terms, candidate documents and warnings."""
    df = index.frequencies(terms)
    each = terms.select("query_id", "term").distinct().join(df, "term", "left").crossJoin(F.broadcast(index.numbers.select("n")))
    kind = F.when(F.col("df").isNull(), "unknown").when(F.col("df") < rare, "rare").when(F.col("df") > common * F.col("n"), "common").otherwise("other")
    counts = each.withColumn("kind", kind).groupBy("query_id").agg(F.count("*").alias("n_terms"), *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("unknown", "rare", "common")))
    cand = index.postings.join(F.broadcast(terms.select("query_id", "term").distinct()), "term").groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_candidates"))
    out = counts.join(cand, "query_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out.withColumn("many_candidates", F.col("n_candidates") > 1000).withColumn("mostly_unknown", F.col("n_unknown") > F.col("n_terms") * 0.5)
