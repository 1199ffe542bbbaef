"""License scans by ordered signature rules.

A text becomes its lower-cased words joined by single spaces. The rules of license_rules.py, several
hundred hand-written regexes in a fixed order, are gated by keywords: the words that a pattern cannot
match without are read off it, and a rule runs on a text only if all of them are among the text's
words; a text with none of the rules' rarest keywords is not scanned at all. Detections are intervals
of words. Where they overlap, priority and containment decide: a detection inside another of at
least its priority is suppressed; of equal intervals the one of higher priority stays, then the
earlier rule. Base phrases are found apart from the rules, and nothing suppresses them.

Defined results: null and empty texts have no words, no detection and score 0; a very long text is
scanned whole, alone in its slice; repeated rows give one row each; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.frames import map_texts, pick
from docloom.llm.license_rules import RULES
from docloom.llm.words import Words, hash_words

#: Phrases whose every occurrence counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Rule:
    """A signature over space-joined words. keywords: words without which it cannot match."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    score: float


#: Priority and score by kind: a text's own sentence, an identifier or address, a notice, a name.
KINDS = {"t": (70, 1.0), "i": (60, 1.0), "h": (50, 0.95), "n": (30, 0.7)}
SHORT = {"@": "licen[cs]e", "~": "(?:version |v ?)?"}
#: Keywords of a rule at most, the longest of those that it has.
KEYWORDS = 3


def keywords(pattern: str) -> tuple[str, ...]:
    """Words that stand in every match of a pattern as whole words, the longest first."""
    rest = pattern.replace(" ?", "\0")  # a space that may be missing joins its neighbours
    while m := re.search(r"\((?:\?:)?([^()]*)\)[?*+]?", rest):
        options = m[1].split("|")
        before = " " if all(o.startswith(" ") for o in options) else ""
        after = " " if all(o.endswith(" ") for o in options) else ""
        rest = f"{rest[: m.start()]}{before}\0{after}{rest[m.end() :]}"
    found = {w for w in rest.split(" ") if re.fullmatch("[a-z0-9]+", w)}
    return tuple(sorted(found, key=lambda w: (-len(w), w))[:KEYWORDS])


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    out = []
    for line in RULES.strip().split("\n"):
        label, kind, pattern = line.split("|", 2)
        for sign, meant in SHORT.items():
            pattern = pattern.replace(sign, meant)
        out.append(Rule(label, pattern, keywords(pattern), *KINDS[kind]))
    return tuple(out)


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in rules()]


@lru_cache(maxsize=1)
def _gate() -> tuple[np.ndarray, dict[int, str], np.ndarray, list[tuple[str, np.ndarray]]]:
    """Hashes of all keywords, their words, those of which a scanned text has one at least, and the base phrases."""
    words = sorted({k for r in rules() for k in r.keywords})
    h = hash_words(words)
    # an anchor of a rule is its first keyword
    anchors = np.unique(hash_words(sorted({r.keywords[0] for r in rules()})))
    return np.unique(h), dict(zip(h.tolist(), words, strict=True)), anchors, [(p, hash_words(p.split())) for p in BASE]


def suppress(found: list[tuple[int, int, Rule, int]]) -> list[tuple[int, int, Rule, int]]:
    """Detections (first word, end word, rule, order of the rule) that no other suppresses."""
    kept: list[tuple[int, int, Rule, int]] = []
    for priority in sorted({d[2].priority for d in found}, reverse=True):
        kept.sort(key=lambda d: d[0])
        starts, reach = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max))
        farthest, level = -1, []
        for d in sorted((d for d in found if d[2].priority == priority), key=lambda d: (d[0], -d[1], d[3])):
            i = bisect_right(starts, d[0])
            if d[1] > farthest and not (i and reach[i - 1] >= d[1]):
                level.append(d)
            farthest = max(farthest, d[1])
        kept += level
    return sorted(kept, key=lambda d: (d[0], d[1], d[3]))


def scan_words(words: list[str], present: set[str]) -> list[tuple[int, int, Rule, int]]:
    """All detections in the words of a text; present: the keywords among them."""
    text = f" {' '.join(words)} "
    starts = list(accumulate((len(x) + 1 for x in words), initial=1))
    found = []
    for order, (rule, pattern) in enumerate(_compiled()):
        if present.issuperset(rule.keywords):
            for m in pattern.finditer(text):
                first = bisect_left(starts, m.start())
                found.append((first, first + m[0].count(" ") + 1, rule, order))
    return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:bigint,last:bigint,label:string,priority:int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = Words(batch.column(1), "alnum")
    keys, names, anchors, base = _gate()
    n, counts = batch.num_rows, w.counts()
    doc = np.repeat(np.arange(n), counts)
    n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    labels: dict[int, set[str]] = {}
    for phrase, h in base:
        at = np.flatnonzero(w.hash[: max(0, len(w.hash) - len(h) + 1)] == h[0])
        for j in range(1, len(h)):
            at = at[(w.hash[at + j] == h[j])]
        at = at[doc[at] == doc[at + len(h) - 1]] if len(at) else at
        n_base += np.bincount(doc[at], minlength=n)
        for p in at.tolist():
            d, k = int(doc[p]), p - int(w.bounds[doc[p]])
            labels.setdefault(d, set()).add(BASE[phrase])
            first[d] = k if first[d] < 0 else min(first[d], k)
            last[d] = max(last[d], k)
    at = np.flatnonzero(np.isin(w.hash, keys))
    held: dict[int, set[str]] = {}
    scanned = set(doc[at[np.isin(w.hash[at], anchors)]].tolist())
    for p in at.tolist():
        if doc[p] in scanned:
            held.setdefault(int(doc[p]), set()).add(names[int(w.hash[p])])
    rows = {}
    for d, present in held.items():
        if not any(present.issuperset(r.keywords) for r, _ in _compiled()):
            continue
        words = [w.word(i).decode("utf-8", "replace") for i in range(w.bounds[d], w.bounds[d + 1])]
        rows[d] = suppress(scan_words(words, present))
    base_out, all_out, score, spans = [], [], [], []
    for d in range(n):
        mine, kept = labels.get(d, set()), rows.get(d, [])
        base_out.append(",".join(sorted(mine)))
        all_out.append(",".join(sorted(mine | {k[2].label for k in kept})))
        score.append(max([0.0] + [1.0] * bool(mine) + [k[2].score for k in kept]))
        spans.append([{"first": k[0], "last": k[1] - 1, "label": k[2].label, "priority": k[2].priority} for k in kept])
    none = first < 0
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array(base_out, pa.string()), pa.array(all_out, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: words, base phrases and their places, labels, score, and the detections that stand."""
    return map_texts(pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), "text", _scan, SCHEMA)


def brute_force(texts: list[str | None]) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each text, every rule tried everywhere, for tests."""
    out = []
    for t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        base = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        found = scan_words(words, set(words).union(*(r.keywords for r in rules())))
        kept = []
        for d in found:
            over = [e for e in found if e is not d and e[0] <= d[0] and d[1] <= e[1] and e[2].priority >= d[2].priority]
            if not any((e[0], e[1]) != (d[0], d[1]) or e[2].priority > d[2].priority or e[3] < d[3] for e in over):
                kept.append(d)
        mine = {label for _, label in base}
        score = max([0.0] + [1.0] * bool(mine) + [d[2].score for d in kept])
        at = [i for i, _ in base]
        out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | {d[2].label for d in kept})), score))
    return out
