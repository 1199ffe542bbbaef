"""Rule classification: rules are data, compiled to columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import analyze as an
from docloom.operators import literals as lit


def matches(rule: lx.Rule, text: Column, has: Callable[[str], Column] | None = None) -> Column:
    """Any keyword substring or pattern; all keywords if the rule requires them. `has` tells of a literal whether the text holds it (by default it is looked for)."""
    low = F.lower(text)
    kw = [F.contains(low, F.lit(k)) if has is None else has(k) for k in rule.keywords]
    pat = [tx.matches(text, low, p, "imU", has) for p in rule.patterns]
    if rule.requires_all and kw:
        return reduce(lambda a, b: a & b, kw) & (reduce(lambda a, b: a | b, pat) if pat else F.lit(True))
    return F.coalesce(reduce(lambda a, b: a | b, kw + pat, F.lit(False)), F.lit(False))


def literals_of(rules: list[lx.Rule]) -> list[str]:
    """What matches() looks for in lower-cased texts: keywords, and literals that patterns need."""
    return [w for r in rules for w in (*r.keywords, *(x for p in r.patterns for x in tx.literals(p)))]


def categories(rules: list[lx.Rule]) -> list[str]:
    """In the order in which rules name them."""
    return list(dict.fromkeys(r.category for r in rules))


def classify(docs: DataFrame, content: str = "text", rules: list[lx.Rule] | None = None, content_type: Column | None = None, automaton: bool = False) -> DataFrame:
    """docs with a struct `classification`: primary, secondary (scores from .3 on), confidences, total, flags, rules, scores.

    A category scores the weights of its matching rules; ties go to the one that the rules name first. Without
    any match the content type names the category, with no confidences and a total of 0. automaton: literals are
    found by one walk over each text in Python workers, not one by one; the rows are the same.
    """
    rules = lx.BASE_RULES if rules is None else rules
    c = F.col(content)
    cats = categories(rules)
    marks = "_marks"
    while marks in docs.columns:
        marks = f"_{marks}"
    marked, has = lit.mark(docs, content, literals_of(rules), marks) if automaton else (docs, None)
    hit = marked.withColumn("_m", F.struct(*(matches(r, c, has).alias(r.name) for r in rules))).drop(marks)
    m = F.col("_m")
    none = F.array().cast("array<string>")
    score = lambda cat: sum((F.when(m[r.name], r.weight).otherwise(0.0) for r in rules if r.category == cat), F.lit(0.0))
    whole = {cat: sum(r.weight for r in rules if r.category == cat) for cat in cats}
    hit = hit.withColumn("_s", F.array(*(F.struct((-F.round(score(cat), 9)).alias("o"), F.lit(i).alias("i"), F.lit(cat).alias("category"), F.least(F.lit(1.0), score(cat) / whole[cat]).alias("confidence")) for i, cat in enumerate(cats))))
    got = F.array_sort(F.filter("_s", lambda x: x["o"] < 0))
    flags = F.array_distinct(F.concat(*(F.when(m[r.name], F.array(*map(F.lit, r.flags)) if r.flags else none).otherwise(none) for r in rules)))
    names = F.concat(*(F.when(m[r.name], F.array(F.lit(r.name))).otherwise(none) for r in rules))
    kind = an.content_type(c) if content_type is None else content_type
    by_type = F.element_at(F.create_map(*(F.lit(x) for kv in lx.CATEGORY_OF_TYPE.items() for x in kv)), kind)
    any_ = F.size(got) > 0
    conf = F.map_from_entries(F.transform(got, lambda x: F.struct(x["category"], x["confidence"])))
    total = F.when(any_, F.aggregate(got, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.greatest(F.size(got), F.lit(1))).otherwise(0.0)
    primary = F.when(any_, F.try_element_at(got, F.lit(1))["category"]).otherwise(by_type)
    secondary = F.transform(F.filter(F.slice(got, F.lit(2), F.greatest(F.size(got), F.lit(1))), lambda x: x["o"] <= -0.3), lambda x: x["category"])
    scores = F.map_from_entries(F.transform(got, lambda x: F.struct(x["category"], -x["o"])))
    return hit.withColumn("classification", F.struct(primary.alias("primary"), secondary.alias("secondary"), conf.alias("confidences"), total.alias("total"), F.array_sort(flags).alias("flags"), names.alias("rules"), scores.alias("scores"))).drop("_m", "_s")


def rule_counts(classified: DataFrame, top: int = 10) -> DataFrame:
    return classified.select(F.explode("classification.rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(top)
