"""All literals of all rules in one pass over a text: an automaton marks which of them stand in it, rules test the marks.

A test of one literal is a scan of the text, so a table of rules costs as many scans as it has literals. Here a text is
walked once whatever their number, and what leaves the walk is a few integers of 63 marks each.

Defined results: the same as contains(lower(text), literal) for each literal. A null text has null marks; the empty literal stands
in every text; repeated literals count once; overlapping ones and those inside others are all found; texts are walked whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks in one integer; its sign stays unused.
BITS = 63


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]):
    """Once for each worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            a.add_word(w, i)
    a.make_automaton()
    return a


def walk(text: str, words: tuple[str, ...]) -> list[int]:
    """The marks of one lower-cased text."""
    marks = [0] * -(-len(words) // BITS)
    found = {i for _, i in _automaton(words).iter(text)} if any(words) else set()
    found.update(i for i, w in enumerate(words) if not w)
    for i in found:
        marks[i // BITS] |= 1 << i % BITS
    return marks


def mark(df: DataFrame, content: str, words: Iterable[str], name: str = "_marks") -> tuple[DataFrame, Callable[[str], Column]]:
    """df with the marks of its texts in the column `name`, and what gives, for one of the words, whether a text holds it."""
    known = tuple(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(known)}

    @F.pandas_udf("array<bigint>")
    def marks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else walk(t, known))

    def has(word: str) -> Column:
        at = place[word]
        return F.getbit(F.get(F.col(name), F.lit(at // BITS)), F.lit(at % BITS)) == 1

    return df.withColumn(name, marks(F.lower(F.col(content)))), has
