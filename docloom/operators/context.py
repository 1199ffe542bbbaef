"""What goes to a language model: history windows, prompts, sources, confidence; and embeddings through a pluggable provider."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(text) / 4).cast("int"))


def context_window(messages: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """System messages, and the newest others while floor(length / 4) adds up to at most the budget; the first that does not fit ends it."""
    newest = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    cost = F.when(F.col(role) == "system", 0).otherwise(F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4))
    return messages.withColumn("used", F.sum(cost).over(newest)).where((F.col(role) == "system") | (F.col("used") <= budget))


def last_messages(messages: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def prompt(found: DataFrame, queries: DataFrame, cut: int = 300) -> DataFrame:
    """query_id, prompt: the found texts (query_id, rank, content), cut, numbered, then the question of queries (query_id, text); just that where nothing is found."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x, i: F.concat(F.lit("[Dokument "), (i + 1).cast("string"), F.lit("] "), F.left(x["content"], F.lit(cut)), F.lit("...")))
    rows = found.groupBy("query_id").agg(F.array_join(body, "\n").alias("body"))
    full = F.concat(F.lit("KONTEXT:\n"), F.col("body"), F.lit("\n\nFRAGE: "), F.col("text"))
    return queries.join(rows, "query_id", "left").select("query_id", F.when(F.col("body").isNull(), F.col("text")).otherwise(full).alias("prompt"))


def sources(found: DataFrame, cut: int = 200, most: int = 5) -> DataFrame:
    return found.where(F.col("rank") <= most).select("query_id", "rank", "doc_id", F.left("content", F.lit(cut)).alias("snippet"), "score")


def confidence(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, confidence (mean score, missing ones .5; 0 where nothing is found), band, for each of queries (query_id)."""
    c = found.groupBy("query_id").agg(F.avg(F.coalesce("score", F.lit(0.5))).alias("confidence"))
    c = queries.select("query_id").join(c, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return c.withColumn("band", F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") > 0.5, "medium").otherwise("low"))


def embed(texts: DataFrame, provider: Callable[[pd.Series], pd.Series], text: str = "text", model: str = "default", most_tokens: int = 512) -> DataFrame:
    """texts with `embedding`, computed once for each distinct text; provider maps a series of texts to a series of lists."""
    udf = F.pandas_udf(provider, T.ArrayType(T.DoubleType()))
    prepared = F.left(F.trim(F.col(text)), F.lit(4 * most_tokens))
    key = F.left(F.sha2(F.concat(prepared, F.lit(f":{model}")).cast("binary"), 256), F.lit(16))
    keyed = texts.withColumn("_key", key)
    once = keyed.select("_key", prepared.alias("_t")).where(F.col("_t").isNotNull()).dropDuplicates(["_key"]).select("_key", udf("_t").alias("embedding"))
    return keyed.join(once, "_key", "left").drop("_key")


def batched(provider: Callable[[pd.Series], pd.Series], size: int = 16, tries: int = 3, wait: float = 0.0) -> Callable[[pd.Series], pd.Series]:
    """provider in batches of `size`, each tried up to `tries` times with a pause that grows by `wait` seconds; a batch that always fails is null."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), size):
            part = texts.iloc[at : at + size]
            for n in range(1, tries + 1):
                try:
                    out.append(pd.Series(list(provider(part)), index=part.index, dtype=object))
                    break
                except Exception:  # noqa: BLE001  any failure of a remote provider counts as one try
                    time.sleep(wait * n)
            else:
                out.append(pd.Series([None] * len(part), index=part.index, dtype=object))
        return pd.concat(out) if out else pd.Series([], dtype=object)

    return run


#: Language-model providers by name: a series of prompts to a series of answers.
PROVIDERS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register_provider(name: str, provider: Callable[[pd.Series], pd.Series]) -> None:
    PROVIDERS[name] = provider


def complete(prompts: DataFrame, provider: str | Callable[[pd.Series], pd.Series], prompt: str = "prompt", **more) -> DataFrame:
    """prompts with `answer` from a provider, in batches with retries."""
    fn = PROVIDERS[provider] if isinstance(provider, str) else provider
    return prompts.withColumn("answer", F.pandas_udf(batched(fn, **more), T.StringType())(F.col(prompt)))


def embedding_stats(df: DataFrame, embedding: str, dim: int) -> DataFrame:
    from docloom.functions import vector as vx

    ok = vx.valid(F.col(embedding), dim)
    return df.agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("valid"), F.avg(ok.cast("double")).alias("success_rate"))
