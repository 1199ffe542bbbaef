"""Text expressions: preprocessing, tokens, stems, n-grams, set similarity, counting. All are native columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx

#: A word in both engines: letters and digits of any script, and the underscore.
TOKEN = r"[\p{L}\p{N}_]+"


def quote(text: str) -> str:
    """text as a regex literal that Java, RE2 and Python read alike."""
    return re.sub(r"([.^$*+?()\[\]{}|\\/\-])", r"\\\1", text)


def _edge(pattern: str) -> str:
    return rf"(?iU){pattern}"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text has any of the words as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of the words the text has as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level, a group at the start of one opened up, without leading word edges."""
    parts, depth = [""], 0
    for c in re.findall(r"\\.|\[[^\]]*\]|.", pattern, re.DOTALL):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for part in (p.removeprefix(r"\b") for p in parts):
        group = re.match(r"\(\?:([^()]+)\)(?![?*{])", part)
        out += group[1].split("|") if group else [part]
    return out


def literals(pattern: str) -> list[str]:
    """Lower-case texts one of which stands wherever the pattern matches: the starts of its alternatives. Empty if unknown."""
    starts = []
    for part in alternatives(pattern):
        word, after = re.match(r"([^\W\d_]*)(.?)", part, re.DOTALL).groups()
        starts.append((word[:-1] if after and after in "?*{" else word).lower())
    return starts if all(len(x) >= 3 for x in starts) else []


def possible(low: Column, pattern: str, has: Callable[[str], Column] | None = None) -> Column:
    """Whether the lower-cased text holds what a match needs: one of its literals (by `has` if given), or a digit where all alternatives start with one."""
    needed = literals(pattern)
    if needed:
        return contains_any(low, needed) if has is None else reduce(lambda a, b: a | b, map(has, needed))
    return low.rlike(r"\p{Nd}") if all(p.startswith(r"\d") for p in alternatives(pattern)) else F.lit(True)


def matches(text: Column, low: Column, pattern: str, flags: str = "iU", has: Callable[[str], Column] | None = None) -> Column:
    """text.rlike(pattern), tried only where the lower-cased text holds what a match needs."""
    return possible(low, pattern, has) & text.rlike(f"(?{flags}){pattern}")


def _swap(text: Column, word: str, to: str) -> Column:
    """Whole-word matches of a literal, whatever their case, replaced; the regex runs only on texts that hold the literal.

    The text is bound once, as a lambda's variable, so that a chain of steps stays as long as its steps. Long s and the
    dotless i match s and i whatever the case, so texts with one of them go to the regex. Its first character is asked for before
    the word's edge, which is the dearer test of the two and would be made at every place.
    """
    odd = [c for c, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")) if plain in word.lower()]
    held = lambda x: reduce(lambda a, c: a | F.contains(x, F.lit(c)), odd, F.contains(F.lower(x), F.lit(word.lower())))
    step = lambda x: F.when(held(x), F.regexp_replace(x, _edge(rf"(?={quote(word[0])})\b{quote(word)}\b"), to)).otherwise(x)
    return F.get(F.transform(F.array(text), step), F.lit(0))


def expand_acronyms(text: Column, acronyms: Mapping[str, str] = lx.ACRONYMS) -> Column:
    for a, full in acronyms.items():
        text = _swap(text, a, f"{a} {full}")
    return text


def normalize_numbers(text: Column, units: Iterable[tuple[str, str]] = lx.UNITS) -> Column:
    """Decimal commas to points, then units spelled out, one after another."""
    text = F.regexp_replace(text, r"(?U)(\d+),(\d+)", "$1.$2")
    for unit, full in units:
        text = _swap(text, unit, full)
    return text


def basic(text: Column) -> Column:
    """Everything but word characters, blanks and hyphens to blanks; blanks collapsed; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))


def stem_word(word: Column, suffixes: Iterable[str] = lx.STEM_SUFFIXES) -> Column:
    """The first suffix that leaves three letters goes; words up to three letters stay."""
    expr = F.when(F.length(word) <= 3, word)
    for s in suffixes:
        expr = expr.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return expr.otherwise(word)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))


def _stemmed(text: Column) -> Column:
    return F.array_join(F.transform(words(text), lambda w: stem_word(w)), " ")


def _rewritten(text: Column) -> Column:
    for pattern, to in lx.INDUSTRIAL_REWRITES:
        text = F.regexp_replace(text, _edge(pattern), to)
    return text


def _glossed(text: Column, glosses: Mapping[str, str] = lx.GLOSSES) -> Column:
    table = F.create_map(*(F.lit(x) for kv in glosses.items() for x in kv))
    return F.array_join(F.transform(words(text), lambda w: F.concat_ws(" ", w, F.element_at(table, w))), " ")


def stem(text: Column) -> Column:
    return _stemmed(basic(text))


def industrial(text: Column) -> Column:
    return _rewritten(stem(text))


def multilingual(text: Column, glosses: Mapping[str, str] = lx.GLOSSES) -> Column:
    return _glossed(industrial(text), glosses)


#: Modes as steps, each on the text that the one before has left.
STEPS: dict[str, Callable[[Column], Column]] = {"basic": basic, "stemming": _stemmed, "industrial": _rewritten, "multilingual": _glossed}
PREPROCESSING = {"basic": basic, "stemming": stem, "industrial": industrial, "multilingual": multilingual}


def preprocess(text: Column, mode: str = "industrial", case_sensitive: bool = False, acronyms: bool = True, numbers: bool = True) -> Column:
    """trim, lower, acronyms, numbers, then the mode; the same for queries and documents. Unknown modes change nothing more."""
    text = F.trim(text)
    if not case_sensitive:
        text = F.lower(text)
    if acronyms:
        text = expand_acronyms(text)
    if numbers:
        text = normalize_numbers(text)
    return PREPROCESSING.get(mode, lambda t: t)(text)


def in_all_modes(docs: DataFrame, content: str = "text") -> DataFrame:
    """docs with a column for each mode, as preprocess() gives it; every step is done once, on the result of the mode before."""
    text = preprocess(F.col(content), mode="")
    for mode, step in STEPS.items():
        docs, text = docs.withColumn(mode, step(text)), F.col(mode)
    return docs


def tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.length(w) >= least)


def ngrams(terms: Column, low: int, high: int) -> Column:
    """Runs of low to high terms, joined by blanks, shorter ones first."""

    def runs(n: int) -> Column:
        count = F.greatest(F.size(terms) - n + 1, F.lit(0))
        starts = F.filter(F.sequence(F.lit(0), count), lambda i: i < count)
        return F.transform(starts, lambda i: F.array_join(F.slice(terms, i + 1, n), " "))

    return F.concat(*(runs(n) for n in range(low, high + 1)))


def with_synonyms(terms: Column, synonyms: Mapping[str, list[str]] = lx.SYNONYMS) -> Column:
    """The terms and, behind them, the synonyms of each."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(F.element_at(table, t), none))))


def query_terms(text: Column, mode: str = "industrial", ngram: tuple[int, int] = (1, 2), synonyms: bool = True, most: int = 50, least: int = 2) -> Column:
    """Distinct terms of a query in order of first place, at most `most`."""
    t = tokens(preprocess(text, mode), least)
    if ngram[1] > 1:
        t = F.concat(t, ngrams(t, 2, ngram[1]))
    if synonyms:
        t = with_synonyms(t)
    return F.slice(F.array_distinct(t), 1, most)


def occurrences(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 for two empty ones, 0 for one."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def highlight(text: Column, terms: Iterable[str], tag: str = "<mark>") -> Column:
    """Whole-word matches of each term, whatever their case, replaced by the tagged term."""
    close = tag.replace("<", "</", 1)
    for t in terms:
        text = F.regexp_replace(text, _edge(rf"\b{quote(t)}\b"), f"{tag}{t}{close}".replace("\\", "\\\\").replace("$", "\\$"))
    return text


def contexts(text: Column, term: str, size: int = 50) -> Column:
    """For each whole-word match the text around it, `size` characters to either side, trimmed."""
    pattern = F.lit(_edge(rf"\b{quote(term)}\b"))
    pieces = F.split(text, _edge(rf"\b{quote(term)}\b"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), zero, lambda acc, i: F.struct((acc["at"] + F.length(F.element_at(pieces, i)) + F.length(F.coalesce(F.try_element_at(found, i), F.lit("")))).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(F.element_at(pieces, i)))).alias("starts")))
    around = F.transform(walk["starts"], lambda s: F.trim(F.substring(text, F.greatest(s - size, F.lit(0)) + 1, s + len(term) + size - F.greatest(s - size, F.lit(0)))))
    return F.when(F.size(found) > 0, around).otherwise(F.array().cast("array<string>"))
