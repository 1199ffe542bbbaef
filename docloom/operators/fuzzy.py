"""Words alike by edit distance, by an equi-join of deletion variants.

Words are alike if 1 - distance / (length of the longer) is at least `least`. A stored word of length l can then be d(l) edits
away from another at most, whatever that one's length. It is cut into d(l) / 2 + 1 even segments, of which at least one has no more than one edit
in any alignment within d(l); such a segment and what it is aligned with become equal when each loses at most one character.
So the stored word is filed under its segments and their variants with one character less, and a query term asks for
those parts of itself, no farther than d(l) from where the segment stands and at most one character longer or shorter, and their
variants. The number of keys of a word grows with its length, not with the choices of d characters out of it. What meets is
verified. Below a similarity of 0.5 segments get too short to tell anything, and the terms are compared with all words of possible length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least similarity for which segments are used, and query terms up to which their keys are broadcast.
SHORTEST, FEW = 0.5, 500


def edits(length: Column, least: float) -> Column:
    """The most edits between a word of this length and any that is alike."""
    return F.floor(F.round(length * ((1 - least) / least), 6)).cast("int")


def _segments(length: Column, least: float) -> Column:
    return F.least(F.floor(edits(length, least) / 2).cast("int") + 1, F.greatest(length, F.lit(1)))


def _bounds(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start from 0 and size of the i-th of n segments."""
    start = F.floor(i * length / n).cast("int")
    return start, F.floor((i + 1) * length / n).cast("int") - start


def _variants(part: Column) -> Column:
    """The part and what is left of it without each of its characters."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), lambda j: F.concat(F.left(part, j - 1), F.substring(part, j + 1, F.length(part))))
    return F.array_distinct(F.concat(F.array(part), F.when(F.length(part) > 0, cut).otherwise(F.array().cast("array<string>"))))


def variants(words: DataFrame, least: float) -> DataFrame:
    """key, word: what a table of distinct words (column word) is filed under; may be stored for later searches of the same least similarity."""
    each = words.where("word IS NOT NULL").select("word", F.length("word").alias("l")).select("word", "l", _segments(F.col("l"), least).alias("m"))
    each = each.select("word", "l", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    start, size = _bounds(F.col("l"), F.col("m"), F.col("i"))
    part = each.select("word", "l", "i", F.substring("word", start + 1, size).alias("part"))
    return part.select("word", "l", "i", F.explode(_variants(F.col("part"))).alias("v")).select(F.xxhash64("l", "i", "v").alias("key"), "word")


def probes(terms: DataFrame, least: float) -> DataFrame:
    """key, q: what query terms (column q) ask for."""
    q = terms.where("q IS NOT NULL").select("q", F.length("q").alias("n")).distinct()
    low, high = F.ceil(F.round(F.col("n") * least, 6)).cast("int"), F.floor(F.round(F.col("n") / least, 6)).cast("int")
    q = q.select("q", "n", F.explode(F.sequence(low, high)).alias("l")).withColumn("d", edits(F.col("l"), least)).withColumn("m", _segments(F.col("l"), least))
    q = q.select("q", "n", "l", "d", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    start, size = _bounds(F.col("l"), F.col("m"), F.col("i"))
    q = q.select("q", "n", "l", "d", "i", start.alias("start"), size.alias("size"))
    first, last = F.greatest(F.col("start") - F.col("d"), F.lit(0)), F.least(F.col("start") + F.col("d"), F.col("n"))
    q = q.where(first <= last).select("q", "n", "l", "i", "size", F.explode(F.sequence(first, last)).alias("at"))
    q = q.select("q", "n", "l", "i", "at", F.explode(F.sequence(F.greatest(F.col("size") - 1, F.lit(0)), F.col("size") + 1)).alias("long")).where(F.col("at") + F.col("long") <= F.col("n"))
    part = q.select("q", "l", "i", F.substring("q", F.col("at") + 1, F.col("long")).alias("part")).distinct()
    return part.select(F.explode(F.transform(_variants(F.col("part")), lambda v: F.xxhash64("l", "i", v))).alias("key"), "q").distinct()


def alike(words: DataFrame, terms: DataFrame, least: float = 0.8, filed: DataFrame | None = None) -> DataFrame:
    """word, q, sim: distinct words (column word) and the query terms (column q) they are alike to. filed: variants() of the words, if stored."""
    longer = F.greatest(F.length("word"), F.length("q"), F.lit(1))
    if least < SHORTEST:
        near = F.abs(F.length("word") - F.length("q")) <= F.round((1 - least) * longer, 9)
        met = words.join(F.broadcast(terms.select("q").distinct()), near)  # the caller's terms
    else:
        asked = probes(terms, least)
        if terms.select("q").distinct().limit(FEW + 1).count() <= FEW:
            asked = F.broadcast(asked)  # a few thousand keys a term
        if filed is None:  # only words of a length that a term can be alike to
            n = F.length("q")
            lengths = terms.select(F.explode(F.sequence(F.ceil(F.round(n * least, 6)).cast("int"), F.floor(F.round(n / least, 6)).cast("int"))).alias("l")).distinct()
            filed = variants(words.join(F.broadcast(lengths), F.length("word") == F.col("l"), "left_semi"), least)
        met = filed.join(asked, "key").select("word", "q").distinct()
    return met.withColumn("sim", 1 - F.levenshtein("word", "q") / longer).where(F.col("sim") >= least - 1e-12)
