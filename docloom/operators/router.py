"""Query analysis and routing, and the facade that runs a strategy over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import fusion, keyword, vectors
from docloom.operators.index import Index


def query_type(text: Column) -> Column:
    """The type of most matching patterns, the first of ties; factual if none."""
    low = F.lower(text)
    votes = [F.struct((-sum((low.rlike(f"(?U){p}").cast("int") for p in pats), F.lit(0))).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, pats) in enumerate(lx.QUERY_TYPES.items())]
    best = F.array_min(F.array(*votes))
    return F.when(best["o"] < 0, best["name"]).otherwise("factual")


def analyze(queries: DataFrame) -> DataFrame:
    """query_id, query_type, technical_terms, domain_keywords, strategy, k, sequential, confidence, language."""
    low = F.lower("text")
    present = lambda ws: F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))
    q = queries.select("query_id", "text", query_type(F.col("text")).alias("query_type"), present(lx.QUERY_TERMS).alias("technical_terms"), present(lx.QUERY_DOMAINS).alias("domain_keywords"))
    kind = F.col("query_type")
    strategy = F.when(kind == "factual", "semantic").when(kind == "procedural", "mmr").when(kind == "troubleshooting", "hybrid").when(kind == "specification", "keyword").when(F.size("technical_terms") > 2, "hybrid").otherwise("semantic")
    k = F.when(kind == "factual", 3).when(kind == "procedural", 5).when(kind == "troubleshooting", 7).otherwise(5)
    return q.select("query_id", kind, "technical_terms", "domain_keywords", strategy.alias("strategy"), k.alias("k"), tx.contains_any(low, lx.SEQUENTIAL_WORDS).alias("sequential"), F.lit(0.8).alias("confidence"), F.lit("de").alias("language"))


@dataclass(frozen=True)
class Request:
    """One search. fetch_k below k becomes the larger of 2k and 20."""

    text: str
    k: int = 5
    fetch_k: int = 20
    strategy: str = "adaptive"
    alpha: float = 0.5
    balance: float = 0.5
    rerank: bool = True
    least: float = 0.0
    boost_words: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not self.text.strip():
            raise ValueError("a query needs text")
        if not 1 <= self.k <= 1000:
            raise ValueError("k must lie in 1..1000")
        if not (0 <= self.alpha <= 1 and 0 <= self.balance <= 1):
            raise ValueError("alpha and balance must lie in 0..1")
        if self.fetch_k < self.k:
            object.__setattr__(self, "fetch_k", max(2 * self.k, 20))


class Engine:
    """Search over a documents table, its index and its vectors (doc_id, vector); without vectors, hash embeddings serve."""

    def __init__(self, docs: DataFrame, index: Index, store: DataFrame | None = None, content: str = "text", dim: int = 32, mode: str | None = "industrial", zero: float = 0.0):
        self.docs = docs.select("doc_id", F.col(content).alias("content"))
        self.more = docs.select("doc_id", *(c for c in ("source", "page") if c in docs.columns))
        self.index, self.dim, self.mode, self.zero = index, dim, mode, zero  # mode: how the index was built; zero: the cosine of a zero vector
        self.store = store if store is not None else self.docs.select("doc_id", vx.hash_embedding(F.col("content"), dim).alias("vector"))

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def _content(self, found: DataFrame) -> DataFrame:
        return F.broadcast(found).join(self.docs, "doc_id")  # at most the rows that a strategy fetches

    def semantic(self, r: Request, vector: DataFrame | None = None) -> DataFrame:
        q = vector if vector is not None else self.spark.createDataFrame([(0, r.text)], "query_id int, text string").select("query_id", vx.hash_embedding(vectors.prepare_query(F.col("text")), self.dim).alias("vector"))
        return self._content(vectors.knn(self.store, q, r.fetch_k, vec_id="doc_id", embedding="vector", zero=self.zero).withColumnRenamed("vec_id", "doc_id").drop("rank"))

    def keyword(self, r: Request) -> DataFrame:
        found = keyword.bm25(self.index, keyword.query_table(self.spark, {0: r.text}, self.mode))
        found = self._content(keyword.top_k(found, r.fetch_k)).withColumn("overlap", fusion.overlap(F.lit(r.text), F.col("content")))
        return found.withColumn("score", (F.col("score") + F.col("overlap")) / 2).drop("raw", "rank")

    def hybrid(self, r: Request) -> DataFrame:
        k = self.keyword(r).withColumn("score", F.col("overlap"))
        return self._content(fusion.service_fuse(self.semantic(r), k, r.alpha))

    def mmr(self, r: Request) -> DataFrame:
        found = self.semantic(r)
        return found.join(fusion.mmr(found, r.k, r.balance), ["query_id", "doc_id"]).withColumn("score", F.col("mmr")).drop("mmr", "place")

    def multi(self, r: Request) -> DataFrame:
        return fusion.multi_strategy([f(r).select("query_id", "doc_id", "content", "score") for f in (self.semantic, self.keyword, self.hybrid, self.mmr)])

    def plan(self, r: Request) -> str:
        """The strategy that runs: adaptive asks the query's type; unknown ones are adaptive."""
        if r.strategy in RETRIEVERS:
            return r.strategy
        return analyze(self.spark.createDataFrame([(0, r.text)], "query_id int, text string")).first().strategy

    def search(self, r: Request) -> DataFrame:
        """doc_id, content, score, rank of the k best, and their source and page where documents have them."""
        found = RETRIEVERS[self.plan(r)](self, r)
        if r.rerank:
            found = found.withColumn("score", fusion.rerank(F.col("score"), F.lit(r.text), F.col("content"), r.boost_words))
        best = keyword.top_k(keyword.threshold(found, r.least), r.k).select("doc_id", "content", "score", "rank")
        return best.join(self.more, "doc_id")


Retriever = Callable[[Engine, Request], DataFrame]
RETRIEVERS: dict[str, Retriever] = {"semantic": Engine.semantic, "keyword": Engine.keyword, "hybrid": Engine.hybrid, "mmr": Engine.mmr, "multi": Engine.multi}


def register_retriever(name: str, fn: Retriever) -> None:
    """A further strategy: a function of engine and request to rows (query_id, doc_id, content, score)."""
    RETRIEVERS[name] = fn


def mock(engine: Engine, r: Request) -> DataFrame:
    """A deterministic stand-in: the share of the query's words that a text has, where it has any."""
    score = fusion.overlap(F.lit(r.text), F.col("content"))
    return engine.docs.select(F.lit(0).alias("query_id"), "doc_id", "content", score.alias("score")).where("score > 0")


register_retriever("mock", mock)
