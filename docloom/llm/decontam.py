"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item, or the whole item where it has fewer.
Its tokens are its runs of up to three words. Tokens are ordered by rarity over all documents.
Containment of a whole window needs every token of it, so the necessary prefix is one token, the
rarest: a document position is a candidate only where that token stands. The token's offset in
its window gives the position the window would start at; it is dropped if that lies before the
text's first word (position) or if too few words follow (length). The rest is verified word by
word over the item-sized window.

Items are taken in blocks of bounded size, each broadcast to a map over the documents, so the
documents are never shuffled and no group of them meets in one task, however frequent a passage.
A larger benchmark only means more blocks, each counted and applied by a pass of its own.

Defined results: a null or empty text has no words and no hits; items without words have no
windows; an item whose id is null marks words but is not counted or listed; repeated items count
once per id; which of equally rare tokens is taken changes no result; repeated documents give one row
each; a very long text is searched whole, alone in its slice; empty tables give empty or hit-free results;
other columns are ignored (decontaminate) or kept (mark), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.frames import fresh, map_texts, pick, with_columns
from docloom.llm.words import U64, Words, gram_hash

#: Words of a window, words of a token, and the most item words whose windows are broadcast at once (some 30 MB).
SIZE, TOKEN, BLOCK_WORDS = 10, 3, 200_000


@dataclass
class Block:
    """The windows of some items: padded word hashes, length, item number; the items' ids; tokens by token length."""

    words: np.ndarray
    length: np.ndarray
    item: np.ndarray
    ids: list[str | None]
    tokens: dict[int, np.ndarray]  # by token length: sorted distinct token hashes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None


def block_of(rows: list[tuple[str | None, str | None]], size: int, token: int) -> Block | None:
    """The windows of these items, or None where no item has a word."""
    w = Words(pa.array([t for _, t in rows], pa.large_string()), "alnum")
    wins, length, item = [], [], []
    for k, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
        n = int(min(size, b - a))
        for s in range(a, b - n + 1 if n else a):
            win = np.zeros(size, U64)
            win[:n] = w.hash[s : s + n]
            wins.append(win)
            length.append(n)
            item.append(k)
    if not wins:
        return None
    m, n, k = np.array(wins), np.array(length), np.array(item)
    tokens = {}
    for t in range(1, token + 1):
        rows_t = m[(n >= t) & (np.minimum(n, token) == t)]
        if len(rows_t):
            grams = np.concatenate([_grams(r[r != 0], t) for r in rows_t])
            tokens[t] = np.unique(grams)
    return Block(m, n, k, [i for i, _ in rows], tokens)


def _grams(h: np.ndarray, t: int) -> np.ndarray:
    return gram_hash(h, t)


def blocks(items: DataFrame, size: int = SIZE, token: int = TOKEN, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items (columns item, text), block by block; the driver holds one partition and one block at a time."""
    rows: list = []
    words = 0
    for r in items.toLocalIterator():
        rows.append((r.item, r.text))
        words += len(r.text or "") // 2 + 1  # a bound of the number of words
        if words >= most * 3:
            if (b := block_of(rows, size, token)) is not None:
                yield b
            rows, words = [], 0
    if rows and (b := block_of(rows, size, token)) is not None:
        yield b


def rarity(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each token of the block stands, over all documents (column text)."""
    tokens = {t: (v, *_bitmap(v)) for t, v in block.tokens.items()}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0), "alnum")
        ks, at, n = [], [], []
        for t, (v, bits, mask) in tokens.items():
            pos, g, doc = _runs(w, t)
            keep = bits[(g & mask).astype(np.int64)]
            i = np.minimum(np.searchsorted(v, g[keep]), len(v) - 1)
            hit = v[i] == g[keep]
            pair = np.unique(doc[keep][hit] * len(v) + i[hit]) % len(v)
            u, c = np.unique(pair, return_counts=True)
            ks += [np.full(len(u), t)]
            at += [u]
            n += [c]
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([cat(ks), cat(at), cat(n)], names=["k", "i", "n"])

    out = {t: np.zeros(len(v), np.int64) for t, v in block.tokens.items()}
    found = map_texts(docs.select("text"), "text", count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most a row for each token of the block
        out[r.k][r.i] = r.n
    return out


def _bitmap(v: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    size = 1 << max(16, (16 * len(v)).bit_length())
    bits = np.zeros(size, bool)
    bits[(v & U64(size - 1)).astype(np.int64)] = True
    return bits, U64(size - 1)


def _runs(w: Words, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and documents of all runs of t words inside one document."""
    doc = np.repeat(np.arange(len(w.bounds) - 1), w.counts())
    g = gram_hash(w.hash, t)
    pos = np.flatnonzero(doc[: len(g)] == doc[t - 1 : t - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    return pos, g[pos], doc[pos]


def prefixes(block: Block, df: dict[int, np.ndarray], token: int = TOKEN) -> None:
    """Gives each window its rarest token (ties: smaller hash, then first place)."""
    by: dict[int, list] = {}
    for i, (row, n) in enumerate(zip(block.words, block.length, strict=True)):
        t = int(min(n, token))
        g = _grams(row[:n], t)
        f = df[t][np.searchsorted(block.tokens[t], g)]
        o = int(np.lexsort((g, f))[0])
        by.setdefault(t, []).append((g[o], i, o))
    block.prefix = {}
    for t, rows in by.items():
        h, i, o = np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        order = np.argsort(h, kind="stable")
        block.prefix[t] = (h[order], i[order], o[order], np.unique(h))


def hits(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified windows: first word (over the batch), document, window number."""
    firsts, docs_, wins = [], [], []
    begin, end = w.bounds[:-1], w.bounds[1:]
    for t, (h, win, off, distinct) in block.prefix.items():
        pos, g, doc = _runs(w, t)
        bits, mask = _bitmap(distinct)
        keep = bits[(g & mask).astype(np.int64)]
        pos, g, doc = pos[keep], g[keep], doc[keep]
        lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
        n = hi - lo
        reps = np.repeat(np.arange(len(g)), n)
        entry = np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n) + lo[reps]
        start, d, i = pos[reps] - off[entry], doc[reps], win[entry]
        inside = (start >= begin[d]) & (start + block.length[i] <= end[d])
        start, d, i = start[inside], d[inside], i[inside]
        ok = np.ones(len(start), bool)
        for j in range(block.words.shape[1]):
            part = j < block.length[i]
            ok[part] &= w.hash[start[part] + j] == block.words[i[part], j]
        firsts.append(start[ok])
        docs_.append(d[ok])
        wins.append(i[ok])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(firsts), cat(docs_), cat(wins)


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "contamination", size: int = SIZE, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """All columns of docs and one struct more: n_words, n_hit, hit (ranges of words as bytes), items; and the struct's name."""
    name = fresh(docs, name)
    schema = "n_words bigint, n_hit bigint, ranges array<struct<first:bigint,last:bigint>>, items array<string>"
    whole = pick(items, item=(item_id, "string"), text=(item_text, "string"))
    scan, spark = docs.select(F.col(f"`{text}`").cast("string").alias("text")), docs.sparkSession
    out, any_block = docs, False
    for block in blocks(whole, size, TOKEN, block_words):
        prefixes(block, rarity(scan, block))
        out = _apply(out, spark.sparkContext.broadcast(block), text, name, schema, first=not any_block)
        any_block = True
    if not any_block:
        out = _apply(out, None, text, name, schema, first=True)
    return out, name


def _apply(docs: DataFrame, shared, text: str, name: str, schema: str, first: bool) -> DataFrame:
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(batch.schema.get_field_index(text)), "alnum")
        n, counts = batch.num_rows, w.counts()
        cover = np.zeros(len(w.hash) + 1, np.int64)
        items: dict[int, set] = {}
        if shared is not None:
            b = shared.value
            start, d, i = hits(w, b)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + b.length[i], -1)
            for k in np.unique(d * len(b.ids) + b.item[i]).tolist():
                items.setdefault(k // len(b.ids), set()).add(b.ids[k % len(b.ids)])
        past = None if first else batch.column(batch.schema.get_field_index(name)).to_pylist()
        if past:
            for r, p in enumerate(past):
                items.setdefault(r, set()).update(p["items"])
                for x in p["ranges"]:
                    cover[w.bounds[r] + x["first"]] += 1
                    cover[w.bounds[r] + x["last"] + 1] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[w.bounds[1:]] - total[w.bounds[:-1]]
        rows = []
        for r in range(n):
            ranges = []
            if n_hit[r]:
                h = np.concatenate(([False], hit[w.bounds[r] : w.bounds[r + 1]], [False]))
                edge = np.flatnonzero(h[1:] != h[:-1])
                ranges = [{"first": int(a), "last": int(z) - 1} for a, z in zip(edge[::2], edge[1::2], strict=True)]
            rows.append({"n_words": int(counts[r]), "n_hit": int(n_hit[r]), "ranges": ranges, "items": sorted(x for x in items.get(r, ()) if x is not None)})
        column = pa.array(rows, kind)
        if first:
            return with_columns(batch, **{name: column})
        at = batch.schema.get_field_index(name)
        return pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    out = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(schema))]) if first else docs.schema
    return map_texts(docs, text, run, out)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, ranges, contaminated, for each row of docs."""
    marked, name = mark(pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), items, **more)
    c = F.col(name)
    return marked.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), c["items"].alias("item_ids"), c.ranges.alias("ranges"), (c.n_hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of decontaminate()'s rows."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
t AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM t),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM win),
m AS (SELECT rid, i, g.n, item_id FROM (SELECT rid, i, n, array_to_string(l[1:n], ' ') AS g FROM l JOIN k ON len(l) >= n) g JOIN win ON win.n = g.n AND win.g = g.g),
h AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS j FROM m) GROUP BY rid),
x AS (SELECT rid, count(*) AS n_items, string_agg(v, ',' ORDER BY encode(v)) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS v FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN x USING (rid)
"""


def brute_force(texts: list[str | None], items: list[tuple], size: int = SIZE) -> list[tuple[int, int, int, str]]:
    """The same counts by plain Python, for tests: n_words, n_hit, n_items, digest."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, split(t)) for i, t in items]
    out = []
    for t in texts:
        w, cover, found = split(t), set(), set()
        for i, x in wins:
            n = min(size, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        cover.update(range(p, p + n))
                        found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(cover), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out
