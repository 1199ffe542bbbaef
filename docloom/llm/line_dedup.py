"""Line deduplication by a log-template tree of fixed depth.

A line's tokens are its lower-cased words; a token with a digit is a variable field. The tree has a
level for the number of tokens and one for each of the first `DEPTH` tokens. In a leaf, the tokens
that fewest of its distinct lines have in their place are generalised first: a line's templates are
itself and, for each k, itself with its k rarest tokens as variable fields (of equal ones the first),
while at least `SIMILAR` of its places keep their token. So lines that differ in few fields meet in
the template that masks just these. A template that stands in at least `min_docs` documents of
different text is recurring, and its lines are dropped from all documents. Documents of the same lines
of words count as one, so a pair of copies does not make its own lines recurring; documents that
differ in digits only are different. The rule depends on no order and on no size of a part.

The texts are read, not gathered: a pass takes the hashes of each document's lines, counts go by
template with partial sums, and only leaves that hold several distinct lines send the token hashes
of those, each once. Leaves are dealt to tasks; one of more than `part` distinct lines is counted by
place and token in relations instead. Lines to drop come back by text and meet the texts in one join.

Defined results: null texts stay null and have no lines; lines without words and lines of fewer
than `min_tokens` tokens are never dropped; of equal lines all go or all stay; ids are carried and
decide nothing, so repeated rows and rows without an id are documents of their own; a very long text or
line is handled alone; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.frames import fresh, map_texts, pick
from docloom.llm.scratch import Scratch
from docloom.llm.words import U64, Words, mix, string_bytes

#: Leading tokens of the tree, share of equal positions, documents of a recurring template, tokens of a line that may go.
DEPTH, SIMILAR, MIN_DOCS, MIN_TOKENS = 3, 0.8, 3, 3
#: Distinct lines of a leaf that one task takes, and bits of the filter of leaves for each of them.
PART, BITS = 1 << 15, 16
FIELD = U64(0xA5A5A5A5A5A5A5A5)  # the variable field


def _placed(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of tokens at their places; a line's template is mixed from their sum and number."""
    return mix(tokens + U64(0x9E3779B97F4A7C15) * (place + 1).astype(U64))


class Lines:
    """Lines of texts: masked token hashes, and for each line with words its text, number in it, template, leaf and hash of its words as they are."""

    def __init__(self, col: pa.Array):
        w = Words(col, "spaced")
        raw, off = string_bytes(col)
        self.n = len(col)
        breaks = np.flatnonzero(raw == 10)
        digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
        self.tokens = np.where(digits[w.end] > digits[w.start], FIELD, w.hash)
        doc = np.repeat(np.arange(self.n), w.counts())
        line = np.searchsorted(breaks, w.start)
        new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))) if len(line) else np.zeros(0, np.int64)
        self.first, self.count = new, np.diff(np.concatenate((new, [len(line)])))
        self.doc = doc[new]
        self.line = line[new] - np.searchsorted(breaks, off[:-1])[self.doc]
        place = np.arange(len(line)) - np.repeat(new, self.count)
        at = _placed(self.tokens, place)
        self.template = mix(np.add.reduceat(at, new) + self.count.astype(U64)) if len(new) else np.zeros(0, U64)
        as_is = _placed(w.hash, place)
        self.plain = mix(np.add.reduceat(as_is, new) + self.count.astype(U64)) if len(new) else np.zeros(0, U64)
        lead = np.add.reduceat(np.where(place < DEPTH, at, U64(0)), new) if len(new) else np.zeros(0, U64)
        self.leaf = mix(lead ^ (self.count.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))


def _measure(min_tokens: int):
    kind = pa.list_(pa.struct([("template", pa.int64()), ("leaf", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(batch.column(1))
        prints, rows = [], []
        for d in range(x.n):
            s, e = x.bounds[d], x.bounds[d + 1]
            prints.append(int(mix(x.plain[s:e] + np.arange(e - s, dtype=U64)).sum(dtype=U64).view(np.int64)))
            keep = np.flatnonzero(x.count[s:e] >= min_tokens) + s
            _, one = np.unique(x.template[keep], return_index=True)
            rows.append([{"template": t, "leaf": v} for t, v in zip(x.template[keep[one]].view(np.int64).tolist(), x.leaf[keep[one]].view(np.int64).tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(rows, kind)], names=["key", "print", "lines"])

    return run


def _leaf_lines(bits, min_tokens: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, wanted = Lines(batch.column(0)), bits.value
        slot = (x.leaf % U64(len(wanted) * 8)).astype(np.int64)
        hit = np.flatnonzero(((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1) & (x.count >= min_tokens))
        _, one = np.unique(x.template[hit], return_index=True)
        hit = hit[one]
        raw = [x.tokens[f : f + c].tobytes() for f, c in zip(x.first[hit], x.count[hit], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x.leaf[hit].view(np.int64)), pa.array(x.template[hit].view(np.int64)), pa.array(raw, pa.binary())], names=["leaf", "template", "tokens"])

    return run


def allowed(n: int, similar: float) -> int:
    """Places of a line of n tokens that may be generalised."""
    return min(max(0, n - DEPTH), n - math.ceil(similar * n - 1e-9))


def _flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of packed lines, one after another, with their line and place."""
    size = np.array(pc.binary_length(col), np.int64) // 8
    line = np.repeat(np.arange(len(size)), size)
    return np.frombuffer(b"".join(v.as_py() for v in col), U64), line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)


def templates(tokens: np.ndarray, line: np.ndarray, place: np.ndarray, often: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and template, for each line with 0, 1, 2, ... of its rarest tokens masked; often: lines of the leaf that have the token in its place."""
    at = _placed(tokens, place)
    size = np.bincount(line)
    start = np.cumsum(size) - size
    top = np.iinfo(np.int64).max
    rare = np.where((tokens == FIELD) | (place < DEPTH), top, often)
    order = np.lexsort((place, rare, line))  # a line's tokens stay in its stretch
    most = np.array([allowed(int(n), similar) for n in range(int(size.max(initial=0)) + 1)])[size]
    masked = (place < most[line]) & (rare[order] < top)
    change = np.where(masked, _placed(np.full(len(place), FIELD), place[order]) - at[order], U64(0))
    change[start] += np.add.reduceat(at, start) + size.astype(U64)
    total = np.cumsum(change, dtype=U64)
    before = np.concatenate(([U64(0)], total))[start]
    plain = mix(np.add.reduceat(at, start) + size.astype(U64))
    return np.concatenate((np.arange(len(size)), line[masked])), np.concatenate((plain, mix(total - before[line])[masked]))


_GROUPS = pa.schema([("template", pa.int64()), ("group", pa.int64())])


def _leaf_groups(similar: float):
    """Lines of whole leaves (leaf, template, tokens) to (template, group): a group for each set of lines that share a masked template."""

    def run(table: pa.Table) -> pa.Table:
        template = np.array(table["template"])
        tokens, line, place = _flat(table["tokens"])
        _, of, n = np.unique(_placed(tokens, place) ^ mix(np.array(table["leaf"]).view(U64))[line], return_inverse=True, return_counts=True)
        line, masked = templates(tokens, line, place, n[of], similar)
        order = np.lexsort((line, masked))
        line, masked = line[order], masked[order]
        first = np.flatnonzero(np.concatenate(([True], masked[1:] != masked[:-1])))
        count = np.diff(np.append(first, len(masked)))
        members = np.repeat(np.bitwise_xor.reduceat(template[line], first), count)  # names the set of lines
        shared = np.repeat(count, count) > 1
        both = np.stack([template[line[shared]], members[shared]])
        both = both[:, np.lexsort(both)]
        new = np.concatenate(([True], (both[:, 1:] != both[:, :-1]).any(axis=0))) if both.shape[1] else np.zeros(0, bool)
        return pa.table([pa.array(x[new]) for x in both], schema=_GROUPS)

    return run


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lines to a row for each token after the leading ones, with a key of leaf, place and token."""
    tokens, line, place = _flat(batch.column(2))
    some = place >= DEPTH
    line, place, tokens = line[some], place[some], tokens[some]
    key = mix(_placed(tokens, place) ^ mix(np.array(batch.column(0)).view(U64)[line]))
    return pa.RecordBatch.from_arrays([pa.array(np.array(batch.column(1))[line]), pa.array(place.astype(np.int32)), pa.array(key.view(np.int64))], names=["template", "place", "key"])


def _masked(similar: float):
    """Lines with the counts of their tokens after the leading ones (template, tokens, counts) to their masked templates."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, line, place = _flat(batch.column(1))
        often = np.zeros(len(tokens), np.int64)
        often[place >= DEPTH] = np.array(batch.column(2).flatten())  # in order of place
        line, masked = templates(tokens, line, place, often, similar)
        return pa.RecordBatch.from_arrays([pa.array(np.array(batch.column(0))[line]), pa.array(masked.view(np.int64))], names=["template", "masked"])

    return run


def _each(fn):
    return lambda batches: (fn(b) for b in batches if b.num_rows)


def _wide_groups(lines: DataFrame, similar: float) -> DataFrame:
    """What _leaf_groups() finds, of leaves of any size (leaf, template, tokens): tokens are counted by leaf and place, with partial sums."""
    each = lines.select("leaf", "template", "tokens").mapInArrow(_each(_places), "template long, place int, key long")
    counts = each.groupBy("key").agg(F.count("*").alias("n"))
    per = each.join(counts, "key").groupBy("template").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("x"))
    per = lines.join(per, "template").select("template", "tokens", F.col("x.n").alias("counts"))
    masked = per.mapInArrow(_each(_masked(similar)), "template long, masked long")
    shared = masked.groupBy("masked").agg(F.bit_xor("template").alias("group"), F.count("*").alias("n")).where("n > 1").select("masked", "group")
    return masked.join(shared, "masked").select("template", "group").distinct()


def recurring(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR, part: int = PART) -> DataFrame:
    """key, templates: of the texts that have lines that go, these. Columns of docs: key, text; equal texts have equal keys."""
    spark = docs.sparkSession
    seen = scratch.table("lines", map_texts(docs, "text", _measure(min_tokens), "key long, print long, lines array<struct<template:bigint,leaf:bigint>>"))
    rows = seen.select("key", "print", F.explode("lines").alias("x")).select("key", "print", "x.template", "x.leaf")
    # leaves with several distinct lines
    leaves = scratch.table("leaves", rows.select("leaf", "template").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    size = 1 << max(18, min(28, (BITS * leaves.count()).bit_length()))
    unsigned = F.when(F.col("leaf") >= 0, F.col("leaf") % size).otherwise(F.pmod(F.col("leaf") % size, F.lit(size)))  # size divides 2**64
    marks = leaves.select((unsigned + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in marks.collect():  # at most 2**28 bits, in pieces of 4 KB
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    found = map_texts(docs.select("text"), "text", _leaf_lines(spark.sparkContext.broadcast(bits), min_tokens), "leaf long, template long, tokens binary")
    found = found.groupBy("leaf", "template").agg(F.first("tokens").alias("tokens")).join(leaves, "leaf")
    found = scratch.table("found", found)
    # whole leaves are dealt to tasks by hash; larger ones go by place and token
    tasks = max(8, leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n // part)
    small = found.where(F.col("n") <= part).select("leaf", "template", "tokens", F.pmod("leaf", F.lit(tasks)).cast("int").alias("task"))
    groups = small.repartitionById(tasks, "task").groupBy("task").applyInArrow(_drop_task(_leaf_groups(similar)), "template long, group long")
    if not leaves.where(F.col("n") > part).isEmpty():
        groups = groups.unionByName(_wide_groups(found.where(F.col("n") > part), similar))
    groups = scratch.table("groups", groups, few=True)
    plain = rows.select("key", "print", "template")
    named = plain.withColumn("group", F.col("template")).unionByName(plain.join(groups, "template").select("key", "print", "template", "group"))
    often = scratch.table("often", named.select("group", "print").distinct().groupBy("group").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("group"), few=True)
    gone = often.select(F.col("group").alias("template")).unionByName(groups.join(often, "group").select("template")).distinct()
    gone = rows.select("key", "template").join(scratch.table("gone", gone, few=True), "template").groupBy("key").agg(F.collect_set("template").alias("templates"))
    return scratch.table("texts", gone)  # written, so that the join to the texts has nothing but exchanges under it and copies of one text can be split


def _drop_task(fn):
    return lambda table: fn(table.drop_columns(["task"]))


def _strip(batch: pa.RecordBatch, text: str, gone: str) -> tuple[pa.Array, list[int], list[int]]:
    at = batch.schema.get_field_index(text)
    col, lists = batch.column(at), batch.column(batch.schema.get_field_index(gone))
    x = Lines(col)
    values, lines, dropped = col.to_pylist(), [], []
    for d, (t, g) in enumerate(zip(values, lists.to_pylist(), strict=True)):
        s, e = x.bounds[d], x.bounds[d + 1]
        out: set[int] = set()
        if g and t is not None:
            out = set(x.line[s:e][np.isin(x.template[s:e].view(np.int64), np.array(g, np.int64))].tolist())
            if out:
                values[d] = "\n".join(v for k, v in enumerate(t.split("\n")) if k not in out)
        lines.append(int(e - s))
        dropped.append(len(out))
    return pa.array(values, col.type), lines, dropped


def strip(docs: DataFrame, text: str = "text", **more) -> tuple[DataFrame, str, str]:
    """All columns of docs with the recurring lines gone from text, and two more: lines with words, and lines dropped; and their names."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    by_text = F.xxhash64(F.col(f"`{text}`").cast("string"))
    gone = recurring(docs.select(by_text.alias("key"), F.col(f"`{text}`").cast("string").alias("text")), scratch, **more)
    key, lists, n_lines, n_dropped = (fresh(docs, c) for c in ("dedup_key", "dedup_gone", "n_lines", "n_dropped"))
    gone = gone.select(F.col("key").alias(key), F.col("templates").alias(lists))
    both = docs.join(gone, by_text == F.col(key), "left").drop(key)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, n, k = _strip(batch, text, lists)
        cols = [new if c == text else batch.column(batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=[*names, n_lines, n_dropped])

    schema = docs.withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema
    return map_texts(both, text, run, schema), n_lines, n_dropped


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without its recurring lines), for each row of docs."""
    out, n, k = strip(pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), **more)
    return out.select("doc_id", F.col(n).alias("n_lines"), F.col(k).alias("n_dropped"), "text")


def brute_force(rows: list[tuple], min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR) -> list[tuple[int, int, str]]:
    """Lines with words, lines dropped and the text left, by plain Python over lists of tokens, for tests."""
    import re

    def words(line: str) -> tuple:
        return tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))

    def tokens(line: str) -> tuple:
        return tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))

    docs = [(d, t, [tokens(x) for x in t.split("\n")] if t is not None else []) for d, t in rows]
    leaves: dict[tuple, set] = {}
    for _, _, ls in docs:
        for x in ls:
            if len(x) >= min_tokens:
                leaves.setdefault((len(x), x[:DEPTH]), set()).add(x)
    of: dict[tuple, set] = {}
    for same in leaves.values():
        for x in same:
            spots = [i for i in range(DEPTH, len(x)) if x[i] != "<*>"]
            spots.sort(key=lambda i, x=x: (sum(y[i] == x[i] for y in same), i))
            hidden = [set(spots[:k]) for k in range(min(len(spots), allowed(len(x), similar)) + 1)]
            of[x] = {tuple("<*>" if i in h else w for i, w in enumerate(x)) for h in hidden}
    texts: dict[tuple, set] = {}
    for _, t, ls in docs:
        text = tuple(y for y in map(words, (t or "").split("\n")) if y)
        for x in ls:
            for g in of.get(x, ()):
                texts.setdefault(g, set()).add(text)
    out = []
    for _, t, ls in docs:
        gone = {i for i, x in enumerate(ls) if any(len(texts[g]) >= min_docs for g in of.get(x, ()))}
        out.append((sum(bool(x) for x in ls), len(gone), t if t is None else "\n".join(v for i, v in enumerate(t.split("\n")) if i not in gone)))
    return out
