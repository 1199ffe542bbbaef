"""Splitters: one text to its chunks. Greedy word packing is a native fold; the recursive and structural ones run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx


def pack_words(text: Column, size: int = 800) -> Column:
    """Array of chunks of blank-joined words: a chunk closes when the next word and a blank would exceed size."""
    words = tx.words(text)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(w) + 1 > size) & (acc["cur"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full | (acc["cur"] == ""), w).otherwise(F.concat(acc["cur"], F.lit(" "), w)).alias("cur"))

    return F.aggregate(words, zero, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def _cut(text: str, sep: str) -> list[str]:
    """Parts of text, each but the first starting with sep; single characters for an empty sep."""
    if not sep:
        return list(text)
    parts = text.split(sep)
    return [p for p in [parts[0], *(sep + x for x in parts[1:])] if p]


def recursive(text: str, size: int = 800, overlap: int = 150, separators: list[str] | None = None) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that the text has and, inside longer parts, at finer ones.

    Separators stay at the start of what follows them. Consecutive parts are joined while they fit; the next
    chunk starts with the last parts of the one before that hold at most overlap characters.
    """
    seps = lx.CHUNK_SEPARATORS if separators is None else separators
    out: list[str] = []
    use, finer = next(((s, seps[i + 1 :]) for i, s in enumerate(seps) if s == "" or s in text), ("", []))
    held: list[str] = []

    def flush() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for part in _cut(text, use):
        if len(part) > size:
            flush()
            held = []
            out += recursive(part, size, overlap, finer) if finer or use else [part]
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """Structural spans by start, with what lies before the first and after the last; the whole text if there are none."""
    found = sorted(((m.start(), m.end(), kind) for p, kind in lx.STRUCTURE_PATTERNS for m in re.finditer(p, text, re.MULTILINE)), key=lambda x: x[0])
    if not found:
        return [(0, len(text), "single_block")]
    head = [(0, found[0][0], "intro")] if found[0][0] > 0 else []
    tail = [(found[-1][1], len(text), "outro")] if found[-1][1] < len(text) else []
    return head + found + tail


def _explode(docs: DataFrame, doc_id: str, content: str, cut) -> DataFrame:
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, s, t) for d, text in zip(batch["doc_id"], batch["text"], strict=True) if isinstance(text, str) for i, (t, s) in enumerate(cut(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "structure", "text"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("text")).mapInPandas(run, f"doc_id {kind}, chunk_index int, structure string, text string")


def split_recursive(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", size: int = 800, overlap: int = 150, separators: list[str] | None = None) -> DataFrame:
    """doc_id, chunk_index, structure (null), text."""
    return _explode(docs, doc_id, content, lambda t: [(c, None) for c in recursive(t, size, overlap, separators)])


def split_structural(docs: DataFrame, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    return _explode(docs, doc_id, content, lambda t: [(t[a:z].strip(), k) for a, z, k in spans(t) if t[a:z].strip()])


def chunk_category(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in lx.CHUNK_CATEGORIES:
        hit = tx.contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def split_industrial(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    chunks = split_recursive(docs, doc_id, content, size, overlap, lx.INDUSTRIAL_SEPARATORS)
    return chunks.withColumn("category", chunk_category(F.col("text")))


def split_words(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", size: int = 800) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(pack_words(F.col(content), size)).alias("chunk_index", "text"))


STRATEGIES = {"stable": split_recursive, "semantic": split_recursive, "structural": split_structural, "industrial": split_industrial, "simple": split_words}


def split(docs: DataFrame, strategy: str = "stable", **more) -> DataFrame:
    return STRATEGIES[strategy](docs, **more)
