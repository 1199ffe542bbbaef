"""Keyword retrieval over an Index: BM25, TF-IDF, boolean, phrase, fuzzy; for one query or a table of queries.

A table of queries (query_id, term) is small against the corpus, the caller's input rather than a
function of the data, and is broadcast to the postings; only postings of its terms are read, and
only they are joined to lengths. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import fuzzy as fz
from docloom.operators.index import Index
from docloom.tables import Tables

K1, B, BOOST = 1.5, 0.75, 1.3


def technical(content: Column, terms=lx.TECHNICAL_TERMS) -> Column:
    return tx.contains_any(F.lower(content), terms)


def query_table(spark: SparkSession, queries: dict[int, str], mode: str | None = "industrial", **more) -> DataFrame:
    """query_id, term, of query texts; mode None takes lower-cased words as they are."""
    rows = spark.createDataFrame([(k, v) for k, v in queries.items()], "query_id int, text string")
    terms = F.array_distinct(tx.tokens(F.lower("text"))) if mode is None else tx.query_terms(F.col("text"), mode, **more)
    return rows.select("query_id", F.explode(terms).alias("term"))


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each key with their rank from 1; a rank limit that Spark applies before the shuffle too."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matches(index: Index, terms: DataFrame) -> DataFrame:
    q = F.broadcast(terms.select("query_id", "term").distinct())
    # the semi-join goes below the postings' aggregate, so only words of the queries are counted and shuffled
    hit = index.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").join(q, "term")
    df = F.broadcast(index.frequencies(terms))  # at most a row for each term of the queries
    return hit.join(df, "term").join(index.lengths, "doc_id").crossJoin(F.broadcast(index.numbers))


def bm25(index: Index, terms: DataFrame, k1: float = K1, b: float = B, boost: float = BOOST) -> DataFrame:
    """query_id, doc_id, raw, score. idf may be negative; documents whose sum is not positive are dropped."""
    tf, df, n = F.col("tf"), F.col("df"), F.col("n")
    part = F.log((n - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _total(_matches(index, terms), part, boost, 10.0)


def tfidf(index: Index, terms: DataFrame, log_tf: bool = True, smooth: bool = True, boost: float = BOOST) -> DataFrame:
    tf = 1 + F.log(F.col("tf")) if log_tf else F.col("tf")
    idf = F.log(F.col("n") / F.col("df")) + (1 if smooth else 0)
    return _total(_matches(index, terms), tf * idf, boost, 20.0)


def _total(rows: DataFrame, part: Column, boost: float, scale: float) -> DataFrame:
    raw = rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("raw"), F.first("technical").alias("technical"))
    raw = raw.withColumn("raw", F.col("raw") * F.when(F.col("technical"), boost).otherwise(1.0)).where(F.col("raw") > 0)
    return raw.select("query_id", "doc_id", "raw", F.least(F.lit(1.0), F.col("raw") / scale).alias("score"))


def threshold(scored: DataFrame, least: float | None) -> DataFrame:
    """None and 0 ask for nothing."""
    return scored.where(F.col("score") >= least) if least else scored


def parse_boolean(query: str) -> tuple[list[str], list[str], list[str]]:
    """AND, OR and NOT terms, lower-cased. Without operators all words are AND terms."""
    must, any_, never = [], [], []
    if " AND " in query:
        must = [w for part in query.split(" AND ") if (w := part.split(" NOT ")[0].strip()) and " OR " not in w]
    elif " OR " not in query and " NOT " not in query:
        must = query.split()
    if " OR " in query:
        any_ = [w for part in query.split(" OR ") for w in part.split() if "NOT" not in w and w != "AND"]
    if " NOT " in query:
        never = re.findall(r"NOT\s+(\w+)", query, re.IGNORECASE)
    low = lambda ws: [w.lower() for w in ws]
    return low(must), low(any_), low(never)


def boolean(docs: DataFrame, query: str, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """doc_id, score of documents that satisfy the query; a filter over the texts, pushed to the scan's stage."""
    must, any_, never = parse_boolean(query)
    low = F.lower(F.col(content))
    ok = F.lit(True)
    for w in must:
        ok = ok & F.contains(low, F.lit(w))
    for w in never:
        ok = ok & ~F.contains(low, F.lit(w))
    base = F.lit(0.5 if must else 0.0) + F.when(tx.contains_any(low, any_), 0.3).otherwise(0.0)
    count = sum((tx.occurrences(low, w) for w in must + any_), F.lit(0))
    score = F.when(base > 0, F.least(F.lit(1.0), base + F.least(F.lit(0.5), 0.05 * count)))
    return docs.where(ok).select(F.col(doc_id).alias("doc_id"), score.alias("score")).where("score IS NOT NULL AND score > 0")


def parse_phrases(query: str) -> list[str]:
    """Quoted parts, or else the whole; blank ones go."""
    return [p.strip().lower() for p in (re.findall(r'"([^"]+)"', query) or [query]) if p.strip()]


def phrase(docs: DataFrame, query: str, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    low = F.lower(F.col(content))
    raw = sum((tx.occurrences(low, p) * (1.0 / len(p.split())) for p in parse_phrases(query)), F.lit(0.0))
    n = F.size(tx.words(F.col(content)))
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.when(n > 0, F.least(F.lit(1.0), raw / (n / 100.0))).alias("score"))
    return scored.where("score > 0")


def fuzzy(index: Index, terms: DataFrame, least: float = 0.8, filed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score: mean over the query's terms of the best similarity 1 - lev/length to a word of the document.

    Terms meet the distinct vocabulary, not documents, by deletion variants of segments; filed: those of the vocabulary, if stored.
    """
    q = terms.select("query_id", "term").distinct()
    size = F.broadcast(q.groupBy("query_id").agg(F.count("*").alias("q_terms")))
    like = fz.alike(index.frequencies().select(F.col("term").alias("word")), q.select(F.col("term").alias("q")), least, filed)
    like = Tables(terms.sparkSession, "fuzzy").write("like", like)  # its size is known then, and only postings of its words are decoded
    hit = index.postings.join(like.select(F.col("word").alias("term")), "term", "left_semi")
    found = hit.select("doc_id", F.col("term").alias("word")).join(like, "word").groupBy("doc_id", "q").agg(F.max("sim").alias("sim"))
    per = found.join(F.broadcast(q.withColumnRenamed("term", "q")), "q").groupBy("query_id", "doc_id").agg(F.sum("sim").alias("s"))
    return per.join(size, "query_id").select("query_id", "doc_id", (F.col("s") / F.col("q_terms")).alias("score"))


def substring(docs: DataFrame, term: str, k: int = 5, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """doc_id, distance of the first k documents, by id, whose text has the term, whatever its case; the distance is constant."""
    hit = docs.where(F.contains(F.lower(F.col(content)), F.lit(term.lower())))
    return hit.select(F.col(doc_id).alias("doc_id"), F.lit(0.5).alias("distance")).orderBy("doc_id").limit(k)


@dataclass(frozen=True)
class Options:
    """Settings of a keyword search; values out of range are reset to the defaults, not refused. replace() gives changed ones for the next plan."""

    algorithm: str = "bm25"
    mode: str | None = "industrial"
    k1: float = K1
    b: float = B
    fuzzy_least: float = 0.8
    ngram: tuple[int, int] = (1, 2)

    def __post_init__(self):
        default = {f.name: f.default for f in fields(Options)}
        ok = {
            "algorithm": self.algorithm in ALGORITHMS,
            "mode": self.mode is None or self.mode in tx.PREPROCESSING,
            "k1": self.k1 > 0,
            "b": 0 <= self.b <= 1,
            "fuzzy_least": 0 <= self.fuzzy_least <= 1,
            "ngram": 1 <= self.ngram[0] <= self.ngram[1],
        }
        for name in (n for n, good in ok.items() if not good):
            object.__setattr__(self, name, default[name])

    def search(self, index: Index, queries: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
        more = {"bm25": {"k1": self.k1, "b": self.b}, "fuzzy": {"least": self.fuzzy_least}}.get(self.algorithm, {})
        return top_k(threshold(ALGORITHMS[self.algorithm](index, queries, **more), least), k)


ALGORITHMS = {"bm25": bm25, "tf_idf": tfidf, "fuzzy": fuzzy}


def search(index: Index, queries: DataFrame, algorithm: str = "bm25", k: int = 5, least: float | None = None) -> DataFrame:
    """The k best documents of each query; unknown algorithms are BM25."""
    return top_k(threshold(ALGORITHMS.get(algorithm, bm25)(index, queries), least), k)


def popularity(queries: DataFrame) -> DataFrame:
    """query, n: how often each text was asked."""
    return queries.groupBy("query").agg(F.count("*").alias("n"))
