"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source; targets share a multiple of all tokens by weight, none above `cap`
times its source's size: sources are ordered by size/weight, those that reach their cap take it,
and the rest is shared by the weights of the others until none is above. A source's rate is
target/size. Each document is emitted floor(rate) times, and once more if a hash of a seed, its id,
source and text, read as a fraction, lies below the rate's fraction. The hash makes reruns agree,
whatever the partitioning; rows that share an id, or have none, draw by their texts.

Sums per source are pre-aggregated in each task, so a source with a third of all rows costs no more
than any other. The table of sources is written first: its measured size lets the planner broadcast
it, so that neither texts nor sizes are shuffled by source, or join it by key where it is large.
Ordering the sources takes one task, of a row per source.

Defined results: null and empty texts have size 0; a null source is a source of its own, last in
the order of weights; a source of size 0 has target and rate 0; a null id, source or text
is hashed as the empty text; repeated rows each count and fare alike; sources of equal level are
ordered by name; a very long text is counted whole; empty tables give no rows; other columns are kept by mix and
ignored by plan, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.frames import fresh
from docloom.llm.scratch import Scratch

#: Weights by the order of sources, repeating; what all targets share, of all sizes; the most repeats of a source.
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def size_of(text: str) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text column."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, from rows of (source, size). One row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.select("source", "source_size", w.cast("long").alias("weight"))
    # Water filling: in order of the size that a unit of weight may take, every source up to some place is at its cap.
    rising = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    total, size_before = F.sum("source_size").over(all_), F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.lit(float(share)) * total - F.lit(float(cap)) * size_before) / weight_left)
    fits = F.col("weight") * F.col("level") <= F.lit(float(cap)) * F.col("source_size")
    # the first source that stays below its cap fixes the level for itself and all after it
    level = F.min(F.when(fits & (F.col("source_size") > 0), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(all_)["level"]
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("weight") * level, F.lit(float(cap)) * F.col("source_size")))
    return per.select("source", "source_size", target.alias("target"))


def fraction(doc_id: str, source: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), part(doc_id), part(source), F.md5(part(text))))
    return F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, for each row of docs."""
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size_of(text).alias("size"), fraction(doc_id, source, text).alias("drawn"))
    return _copies(sized, _written(targets(sized.select("source", "size"), **more)))


def _written(per: DataFrame) -> DataFrame:
    """The table of sources, of known size."""
    return Scratch(per.sparkSession, "mix").table("sources", per, few=True)


def _copies(sized: DataFrame, per: DataFrame) -> DataFrame:
    per = per.select(F.col("source").alias("s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # the sources are few against the documents; the planner broadcasts them only if their measured size allows it
    out = sized.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    whole = F.floor("rate")
    copies = whole + F.when(F.col("drawn") < F.col("rate") - whole, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).drop("drawn").withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", copy: str = "copy", **more) -> DataFrame:
    """The mixed corpus: all columns of docs, each row as often as the mix takes it, numbered from 0 in `copy`."""
    copy = fresh(docs, copy)
    key, rate = fresh(docs, "mix_source"), fresh(docs, "mix_rate")
    sized = docs.select(F.col(f"`{source}`").cast("string").alias("source"), size_of(text).alias("size"))
    per = targets(sized, **more).select(F.col("source").alias(key), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    out = docs.join(_written(per), docs[f"`{source}`"].cast("string").eqNullSafe(F.col(key)))
    whole = F.floor(rate)
    n = (whole + F.when(fraction(doc_id, source, text) < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    out = out.withColumn(copy, F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n)))
    return out.drop(key, rate)


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS print, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), per AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per0
), lev AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM per WINDOW b AS (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fix AS (
  SELECT level AS l FROM lev WHERE weight * level <= 2.0::DOUBLE * source_size AND source_size > 0
  ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST LIMIT 1
), tgt AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(weight * (SELECT l FROM fix), 2.0::DOUBLE * source_size)) AS target FROM lev
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || coalesce(s.source, '') || ':' || s.print), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
