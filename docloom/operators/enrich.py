"""Enrichment of chunks: quality, safety, expertise, domain, section, boost, tags, hash, related chunks, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import analyze as an
from docloom.operators import classify as cl
from docloom.tables import Tables


def quality(confidence: Column, total: Column, length: Column, n_keywords: Column, has_steps: Column, n_flags: Column) -> Column:
    s = (confidence + total) / 2 + F.when(length > 200, 0.1).otherwise(0.0) + F.when(n_keywords >= 3, 0.1).otherwise(0.0) + F.when(has_steps, 0.1).otherwise(0.0) + F.when(n_flags > 0, 0.05).otherwise(0.0)
    s = F.round(F.least(F.lit(1.0), s), 9)
    return F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "moderate").otherwise("poor")


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | tx.matches(text, F.lower(text), p)
    return out


def safety(text: Column, flags: Column, primary: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(_any(text, lx.CRITICAL_PATTERNS), "critical")
        .when(F.array_contains(flags, "has_warnings") & tx.contains_any(low, lx.HIGH_SAFETY), "high")
        .when(primary == "safety", "medium")
        .when(tx.contains_any(low, lx.LOW_SAFETY), "low")
        .otherwise("none")
    )


def expertise(text: Column, flags: Column, primary: Column) -> Column:
    return (
        F.when(_any(text, lx.EXPERT_PATTERNS), "expert")
        .when(F.array_contains(flags, "requires_expertise") | primary.isin("maintenance", "troubleshooting", "installation"), "skilled")
        .when(primary == "operation", "trained")
        .when(tx.contains_any(F.lower(text), lx.BASIC_TERMS), "basic")
        .otherwise("anyone")
    )


def domain(text: Column, domains: dict = lx.DOMAINS, least: float = 1.0) -> Column:
    """The best-scoring domain (1 for each keyword, 1.5 for each match of a pattern), the first of ties, from `least` on."""
    low = F.lower(text)
    scored = [F.struct((-(tx.hits(low, kw) + 1.5 * sum((F.regexp_count(text, F.lit(f"(?iU){p}")) for p in pats), F.lit(0)))).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, (kw, pats)) in enumerate(domains.items())]
    best = F.array_min(F.array(*scored))
    return F.when(best["o"] <= -least, best["name"]).otherwise("general")


def section(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, p in lx.SECTIONS.items():
        hit = tx.matches(low, low, p, "U")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("content")


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def search_boost(quality_: Column, safety_: Column, flags: Column) -> Column:
    content = 1.0 + F.when(F.array_contains(flags, "has_procedures"), 0.2).otherwise(0.0) + F.when(F.array_contains(flags, "has_specifications"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), _lookup(lx.QUALITY_BOOST, quality_) * _lookup(lx.SAFETY_BOOST, safety_) * content))


def prerequisites(expertise_: Column, primary: Column) -> Column:
    base = F.create_map(*(x for k, v in lx.PREREQUISITES.items() for x in (F.lit(k), F.lit(", ".join(v) or None).cast("string"))))
    out = F.concat_ws(", ", F.element_at(base, expertise_), _lookup(lx.CATEGORY_PREREQUISITES, primary))
    return F.when(out == "", "Keine").otherwise(out)


def filter_tags(domain_: Column, safety_: Column, flags: Column, primary: Column) -> Column:
    tag = lambda f: F.when(F.array_contains(flags, f), f.removeprefix("has_"))
    return F.concat_ws(", ", F.when(domain_ != "general", F.concat(F.lit("domain:"), domain_)), F.when(safety_ != "none", F.concat(F.lit("safety:"), safety_)), tag("has_warnings"), tag("has_procedures"), tag("has_specifications"), F.concat(F.lit("category:"), primary))


def distributions(enriched: DataFrame, fields: tuple[str, ...] = ("quality", "safety", "expertise", "domain", "section")) -> DataFrame:
    """field, value, n, percent: how often each value of the enrichment's fields occurs; one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("enrichment")[f].alias("value")) for f in fields))
    counts = enriched.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("field")))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def enrich(chunks: DataFrame, content: str = "text", rules: list[lx.Rule] | None = None, domains: dict = lx.DOMAINS, words: lx.Analyzer = lx.Analyzer(), blank: Column | None = None) -> DataFrame:
    """chunks with analysis, classification and a struct `enrichment`; one analysis and one classification a row. Blank texts get the fallback, or the rows where `blank` holds."""
    a = an.analyze(chunks, content, words)
    df = cl.classify(a, content, rules, F.col("analysis.content_type"))
    c, an_, k = F.col(content), F.col("analysis"), F.col("classification")
    df = df.withColumn("_e", F.struct(quality(an_["confidence"], k["total"], F.length(c), F.size(an_["keywords"]), an_["has_steps"], F.size(k["flags"])).alias("quality"), safety(c, k["flags"], k["primary"]).alias("safety"), expertise(c, k["flags"], k["primary"]).alias("expertise"), domain(c, domains).alias("domain"), section(c).alias("section")))
    e = F.col("_e")
    full = F.struct(*(e[x].alias(x) for x in ("quality", "safety", "expertise", "domain", "section")), search_boost(e["quality"], e["safety"], k["flags"]).alias("search_boost"), prerequisites(e["expertise"], k["primary"]).alias("prerequisites"), filter_tags(e["domain"], e["safety"], k["flags"], k["primary"]).alias("filter_tags"), content_hash(c).alias("content_hash"))
    blank = c.isNull() | (F.trim(c) == "") if blank is None else blank
    lit = lambda v, n: F.lit(v).alias(n)
    fallback = F.struct(lit("poor", "quality"), lit("none", "safety"), lit("anyone", "expertise"), lit("general", "domain"), lit("content", "section"), lit(0.5, "search_boost"), lit("Keine", "prerequisites"), lit("", "filter_tags"), content_hash(F.coalesce(c, F.lit(""))).alias("content_hash"))
    return df.withColumn("enrichment", F.when(blank, fallback).otherwise(full)).drop("_e")


#: Indexes of a source that the first round looks at, and how many times more each next round does.
WINDOW, GROWTH = 256, 8


def related_chunks(chunks: DataFrame, least: float = 0.5, most: int = 5, near: int = 2, window: int = WINDOW) -> DataFrame:
    """source, chunk_index, related (the first `most` indexes): columns source, chunk_index, category, domain, keywords (array).

    A pair scores .3 for equal categories, .2 for equal domains, .1 for places at most `near` apart and .4 times the shared keywords
    over the larger set. Pairs of equal category, of equal domain, or of neither must share so many keywords to reach `least`; so they must share one
    of the rarest, as many as a set of their size can do without, and their sets must be of like size (a prefix-filtered join). Where equal labels
    suffice, the first chunks of equal labels are what counts; neighbours are met by place.
    Only the first `most` are kept, so rounds take the partners by rising index: a chunk that has found its `most` among
    lower indexes than a round's is left out of it. A word in all chunks of a source thus pairs no chunk with all others,
    unless fewer than `most` of those it may be related to are. Null keywords are none; rows without source or index are not related.
    """
    tables = Tables(chunks.sparkSession, "related")
    base = chunks.where("source IS NOT NULL AND chunk_index IS NOT NULL").select("source", "chunk_index", "category", "domain", F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: w.isNotNull()), lambda w: F.xxhash64(w)))).alias("kw"))
    low = base.groupBy("source").agg(F.min("chunk_index").alias("low"))
    base = base.join(low, "source").select("source", "chunk_index", (F.col("chunk_index") - F.col("low")).alias("at"), "category", "domain", F.size("kw").alias("n"), "kw")
    base = tables.write("base", base)
    words = base.select("source", "chunk_index", "at", "category", "domain", "n", F.explode("kw").alias("w"))
    df = words.groupBy("source", "w").agg(F.count("*").alias("df"))
    order = words.join(df, ["source", "w"]).groupBy("source", "chunk_index", "at", "category", "domain", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("rare"))
    order = tables.write("order", order)
    kinds = []
    for k, (keys, gift) in enumerate(((["category", "domain"], 0.5), (["category"], 0.3), (["domain"], 0.2), ([], 0.0))):
        share = round((least - gift) / 0.4, 9)  # of the larger set, what a pair of such labels must share
        if 0 < share <= 1:
            label = F.xxhash64(F.lit(k), *keys) if keys else F.lit(k).cast("long")
            rows = order.where(" AND ".join([f"{c} IS NOT NULL" for c in keys]) or "true")
            length = F.col("n") - F.ceil(F.round(F.lit(share) * F.col("n"), 6)).cast("int") + 1
            kinds.append(rows.select("source", "chunk_index", "at", "n", label.alias("label"), F.lit(share).alias("share"), F.explode(F.slice("rare", 1, length)).alias("w")))
    prefix = reduce(DataFrame.unionByName, kinds) if kinds else None
    here = base.select("source", "chunk_index", "category", "domain", "n", "kw")
    there = base.select("source", F.col("chunk_index").alias("other"), F.col("at").alias("other_at"), F.col("category").alias("c2"), F.col("domain").alias("d2"), F.col("n").alias("n2"), F.col("kw").alias("kw2"))

    def verified(pairs: DataFrame) -> DataFrame:
        pair = pairs.where("chunk_index <> other").distinct().join(here, ["source", "chunk_index"]).join(there, ["source", "other"])
        score = F.when(F.col("category") == F.col("c2"), 0.3).otherwise(0.0) + 0.4 * F.size(F.array_intersect("kw", "kw2")) / F.greatest("n", "n2", F.lit(1)) + F.when(F.col("domain") == F.col("d2"), 0.2).otherwise(0.0) + F.when(F.abs(F.col("chunk_index") - F.col("other")) <= near, 0.1).otherwise(0.0)
        return pair.where(F.round(score, 9) >= least).select("source", "chunk_index", "other", "other_at")

    def first(found: DataFrame) -> DataFrame:
        place = W.partitionBy("source", "chunk_index").orderBy("other")
        return found.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("place")

    pairs = base.select("source", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - near, F.col("chunk_index") + near)).alias("other"))
    for keys, gift in ((["category", "domain"], 0.5), (["category"], 0.3), (["domain"], 0.2), ([], 0.0)):
        if gift >= least:
            head = W.partitionBy("source", *keys).orderBy("chunk_index")
            some = base.withColumn("place", F.row_number().over(head)).where(F.col("place") <= most + 1).select("source", *keys, F.col("chunk_index").alias("other"))
            pairs = pairs.unionByName(base.join(some, ["source", *keys]).select("source", "chunk_index", "other"))
    found = tables.write("found", first(verified(pairs)))
    last = prefix and base.agg(F.max("at")).first()[0]
    start, r = 0, 0
    while prefix is not None and last is not None and start <= last:
        end = start + window * GROWTH**r
        enough = found.where(F.col("other_at") < start).groupBy("source", "chunk_index").agg(F.count("*").alias("have")).where(F.col("have") >= most)
        ask = prefix.join(enough, ["source", "chunk_index"], "left_anti")
        met = prefix.where((F.col("at") >= start) & (F.col("at") < end)).select("source", "label", "w", F.col("chunk_index").alias("other"), F.col("n").alias("n2"))
        like = ask.join(met, ["source", "label", "w"]).where(F.least("n", "n2") >= F.round(F.col("share") * F.greatest("n", "n2"), 6)).select("source", "chunk_index", "other")
        new = tables.write(f"found{r}", first(found.unionByName(verified(like))))
        tables.drop(f"found{r - 1}" if r else "found")
        found, start, r = new, end, r + 1
    return found.groupBy("source", "chunk_index").agg(F.array_sort(F.collect_list("other")).alias("related"))


def document_stats(chunks: DataFrame, most: int = 20) -> DataFrame:
    """Of each source: chunks, content types, chunks with steps, mean length, distinct keywords and the `most` frequent ones, in that order. Columns: source, text, analysis."""
    base = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_set("analysis.content_type")).alias("types"), F.sum(F.col("analysis.has_steps").cast("long")).alias("with_steps"), F.avg(F.length("text")).alias("avg_length"))
    word = chunks.select("source", F.explode(F.array_distinct("analysis.keywords")).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "w"))
    top = word.withColumn("place", place).where(F.col("place") <= most).groupBy(F.col("source").alias("s1")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("keywords"))
    size = word.groupBy(F.col("source").alias("s2")).agg(F.count("*").alias("n_keywords"))
    out = base.join(size, F.col("source").eqNullSafe(F.col("s2")), "left").join(top, F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1", "s2")
    return out.withColumns({"n_keywords": F.coalesce("n_keywords", F.lit(0)), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})
