"""Completions by equality: a table of the most frequent terms of each prefix.

A row for each prefix and rank, made by one ranked window: tasks keep no more than the wanted terms of a prefix before
they shuffle, so a short prefix of many terms does not gather them. The table is sorted by prefix over ranges and
written in small row groups, and a completion reads those of its prefix. It can be brought up to date from changed
terms alone: prefixes of which a changed term is or was among the first are ranked anew, the others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters of a prefix, terms of each, bytes of a row group.
LETTERS, TERMS, GROUP_BYTES = 6, 10, 1 << 20


def ranked(frequencies: DataFrame, most: int = TERMS, letters: int = LETTERS) -> DataFrame:
    """prefix, rank, term, df, from term, df: by falling frequency, then term. Prefixes of up to `letters` letters."""
    each = frequencies.where("term <> ''").select(F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(letters)))).alias("n"), "term", "df").select(F.left("term", F.col("n")).alias("prefix"), "term", "df")
    place = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("df"), "term"))
    return each.withColumn("rank", place).where(F.col("rank") <= most).select("prefix", "rank", "term", "df")


def store(table: DataFrame, path: str) -> DataFrame:
    """Writes the table for look-ups and returns it as read back."""
    table.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return table.sparkSession.read.parquet(path)


def complete(table: DataFrame, prefix: str, most: int = TERMS) -> DataFrame:
    """term, df of the prefix, most frequent first; the prefix as the index has its terms, so lower-cased."""
    return table.where((F.col("prefix") == prefix.lower()) & (F.col("rank") <= most)).select("term", "df", "rank").orderBy("rank").drop("rank")


def updated(table: DataFrame, frequencies: DataFrame, changed: DataFrame, most: int = TERMS, letters: int = LETTERS) -> DataFrame:
    """The table after the frequencies of the changed terms (column term) have become those of `frequencies`, of which it reads the touched prefixes only."""
    cut = lambda df: df.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(letters))), lambda n: F.left("term", n))).alias("prefix")).distinct()
    touched = cut(changed.where("term <> ''"))
    first = touched.select(F.left("prefix", F.lit(1)).alias("letter")).distinct()
    some = frequencies.where("term <> ''").join(first, F.left("term", F.lit(1)) == F.col("letter"), "left_semi")
    anew = ranked(some, most, letters).join(touched, "prefix", "left_semi")
    return table.join(touched, "prefix", "left_anti").unionByName(anew)
