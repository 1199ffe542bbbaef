"""Stupid-backoff scores of whole documents, computed relationally.

The score of a word after a context is its n-gram's count over the context's, or `backoff` times
the score after the shorter context where the n-gram is not found. The counts are those of the
whole corpus; with `leave_out` each document is scored by those of all others, so that it doesn't
vouch for itself, and a word found nowhere else counts as half a word. A document's score is the
mean natural log over its words.

Documents are packed into blocks of bounded bytes: dictionary and stream of word numbers. A block
explodes its n-grams once each, with its own counts, to the buckets that their hashes name; a bucket
is a partition of the count tables, sums over the blocks, and answers each in the order it asked. The answers meet
their block again by its number, where they are joined to the n-grams of each document and summed.
What is dealt out grows with the distinct n-grams of blocks; a frequent n-gram is a row of a block,
not of a document, so no key gathers more than one entry from each block. Bucket and block sizes do
not depend on the data. In a bucket an n-gram is known by 40 further bits of its
hash, so one in some millions shares its counts with another, at every size of the corpus.

Defined results: null and empty texts have no words and a null score; the first words of a text
have the shorter contexts that exist; repeated rows are documents of their own and score alike, as equal texts do; a very long text is a block of its own; a null
id stays null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.frames import pick
from docloom.llm.scratch import Scratch
from docloom.llm.words import U64, Words, grow, mix, pieces, shrink

#: Longest n-gram, factor of each step back, bytes of text of a block, n-grams of a bucket.
ORDER, BACKOFF, BLOCK, BUCKET = 3, 0.4, 6 << 20, 1 << 21
#: Bits that tell the n-grams of a bucket apart, and words.
BITS, WORD_BITS = 40, 48
_STREAM = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.int64()), ("dictionary", pa.binary()), ("stream", pa.binary())])


def _blocks(most: int):
    def run(batches):
        first, k = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for piece in pieces(batch, "text", most):
                w = Words(piece.column(1), "spaced")
                words, stream, often = np.unique(w.hash >> U64(64 - WORD_BITS), return_inverse=True, return_counts=True)
                by = np.argsort(-often, kind="stable")  # frequent words get small numbers
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
                words, stream = words[by], place[stream]
                cols = ([first + k], [piece.column(0).to_pylist()], [w.counts().tolist()], [len(stream)], [shrink(np.diff(words, prepend=U64(0)))], [shrink(stream)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STREAM, strict=True)], schema=_STREAM)
                k += 1

    return run


class Grams:
    """The n-grams of a block up to an order: distinct ones by hash, where each occurrence points, and counts."""

    def __init__(self, row: dict, order: int):
        words, stream = np.cumsum(grow(row["dictionary"]).view(U64), dtype=U64), grow(row["stream"])
        self.counts = np.array(row["counts"], np.int64)
        self.docs = row["docs"]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        place = np.arange(len(stream)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        h, self.at, self.of, self.hash, self.own = words[stream], [], [], [], []
        acc = mix(h + U64(1))
        for n in range(1, order + 1):
            if n > 1:  # the n-gram that ends here: that of n - 1 words ending here, after one word more
                prev = np.concatenate((np.zeros(n - 1, U64), h[: max(0, len(h) - n + 1)]))[: len(h)]
                acc = mix(acc * U64(0x9E3779B97F4A7C15) + prev + U64(n))
            pos = np.flatnonzero(place >= n - 1)
            u, of = np.unique(acc[pos], return_inverse=True)
            self.at.append(pos)
            self.of.append(of)
            self.hash.append(u)
            self.own.append(np.bincount(of, minlength=len(u)))

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All distinct n-grams by hash, which buckets share out in stretches: the order, buckets asked, edges, places in the bucket, counts."""
        h, c = np.concatenate(self.hash), np.concatenate(self.own)
        order = np.argsort(h)
        h, m = h[order], U64(buckets)
        b = ((h >> U64(32)) * m + (((h & U64(0xFFFFFFFF)) * m) >> U64(32))) >> U64(32)
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)  # only buckets it asks, however many there are
        return order, b[at].astype(np.int64), np.concatenate((at, [len(b)])), ((h * m) >> U64(64 - BITS)).astype(np.int64), c[order]


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])


def _ask(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, asked, edge, h, c = Grams(row, order).asked(buckets)
                for some in np.array_split(np.arange(len(asked)), -(-len(asked) // 64)) if len(asked) else ():
                    cut = [(edge[b], edge[b + 1]) for b in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(asked[some], pa.int32()), pa.array(np.full(len(some), row["block"]), pa.int64()), pa.array([shrink(np.diff(h[s:e], prepend=0)) for s, e in cut], pa.binary()), pa.array([shrink(c[s:e]) for s, e in cut], pa.binary())], schema=_ASK)

    return run


def _count(table: pa.Table) -> pa.Table:
    """Sums the blocks' counts of each n-gram of the bucket and answers every block with those of the others."""
    each = [np.cumsum(grow(v.as_buffer())) for v in table["grams"]]
    sizes, h = np.array([len(x) for x in each]), np.concatenate(each)
    c = np.concatenate([grow(v.as_buffer()) for v in table["counts"]])
    at = np.argsort(h)
    new = np.concatenate(([True], h[at][1:] != h[at][:-1]))
    total = np.add.reduceat(c[at], np.flatnonzero(new))
    out = np.empty(len(h), np.int64)
    out[at] = total[np.cumsum(new) - 1]
    out -= c
    edge = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table([table["block"], table["bucket"], pa.array([shrink(out[s:e]) for s, e in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], schema=_REPLY)


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_total", pa.float64())])


def _score(order: int, backoff: float, total_words: int, buckets: int, leave_out: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = dict(zip(right["bucket"].to_pylist(), right["counts"], strict=True))
        for row in left.to_pylist():
            g = Grams(row, order)
            at, asked, edge, _, own = g.asked(buckets)
            everywhere = np.zeros(len(at), np.int64)
            for i, b in enumerate(asked.tolist()):
                everywhere[at[edge[i] : edge[i + 1]]] = grow(replies[b].as_buffer()) + own[edge[i] : edge[i + 1]]
            start = np.concatenate(([0], np.cumsum([len(h) for h in g.hash])))
            n = len(g.doc)
            others = total_words - leave_out * g.counts[g.doc]  # words that counts were taken from
            score, found, context = np.zeros(n), np.zeros(n, bool), others.astype(np.float64)
            levels = []
            for k in range(order):
                rest = np.zeros(n, np.int64)
                rest[g.at[k]] = everywhere[start[k] : start[k + 1]][g.of[k]] - leave_out * _within(g.doc[g.at[k]], g.of[k], len(g.hash[k]))
                levels.append(rest)
            for k in range(order - 1, -1, -1):
                here = np.zeros(n, bool)
                here[g.at[k]] = True
                if k:
                    context = np.zeros(n)
                    context[1:] = levels[k - 1][:-1]  # the n-gram of the words before
                hit = here & ~found & (levels[k] > 0) & ((k == 0) | (context > 0))
                ratio = np.log(np.maximum(levels[k], 1)) - np.log(np.maximum(others if k == 0 else context, 1))
                score[hit] += ratio[hit]
                found |= hit
                score[here & ~found & (k > 0)] += math.log(backoff)
            score[~found] += math.log(0.5) - np.log(np.maximum(others[~found], 1))
            sums = np.bincount(g.doc, score, minlength=len(g.counts))
            out.append(pa.table([pa.array(g.docs, pa.int64()), pa.array(g.counts), pa.array(sums)], schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return run


def _within(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """For each occurrence how often its own document has the n-gram."""
    _, of, c = np.unique(doc * max(1, n) + gram, return_inverse=True, return_counts=True)
    return c[of]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, block: int = BLOCK, bucket: int = BUCKET, leave_out: bool = False) -> DataFrame:
    """doc_id, n_words, score (mean natural log over the words, null without words), log_total (their sum)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    texts = pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    ddl = "block long, docs array<long>, counts array<long>, words long, dictionary binary, stream binary"
    stream = scratch.table("stream", texts.mapInArrow(_blocks(block), ddl))
    total = stream.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n
    buckets = max(8, -(-total * order // bucket))
    asked = stream.mapInArrow(_ask(order, buckets), "bucket int, block long, grams binary, counts binary")
    replies = asked.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_count, "block long, bucket int, counts binary")
    scored = stream.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(order, backoff, total, buckets, leave_out), "doc_id long, n_words long, log_total double")
    return scored.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("log_total") / F.col("n_words")).alias("score"), "log_total")


def brute_force(texts: list[str | None], order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = False) -> list[tuple[int, float]]:
    """Words and summed logs by plain counting, for tests."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    own = [Counter(tuple(w[i - n + 1 : i + 1]) for i in range(len(w)) for n in range(1, order + 1) if i - n + 1 >= 0) for w in words]
    everywhere, total, out = sum(own, Counter()), sum(map(len, words)), []
    for w, mine in zip(words, own, strict=True):
        s = 0.0
        for i in range(len(w)):
            x = 0.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                have = everywhere[gram] - leave_out * mine[gram]
                base = everywhere[gram[:-1]] - leave_out * mine[gram[:-1]] if n > 1 else total - leave_out * len(w)
                if have > 0 and base > 0:
                    x += math.log(have / max(1, base))
                    break
                if n > 1:
                    x += math.log(backoff)
            else:
                x += math.log(0.5 / max(1, total - leave_out * len(w)))
            s += x
        out.append((len(w), s))
    return out
