"""Positional postings in blocks: top-k that skips blocks, phrases and proximity from postings alone.

A block holds up to DOCS documents that follow each other in the input, and has a row for each of its terms: the documents
as places in the block, how often and where the term stands in each (gaps between positions), and its impacts, those
pairs of frequency and document length that no other pair of the row beats. Impacts bound what a row can add to a BM25 score
for any parameters and whatever the corpus has become. A block is built inside one task from its documents' words, so
building shuffles nothing. A task writes its rows in runs of RUN bytes, each sorted by term and block, so a query opens in each
run the pages of its terms, and a term in all documents is spread over all files.

top_k() needs three steps in one plan. Of the rows of a query's terms it reads frequencies and impacts, which give each
block's highest possible score. The most promising blocks are decoded and scored, and the k-th score found is the query's
threshold; of the others only those are decoded whose highest possible score is above it, or equal and with a smaller id in the block. Terms in more than half of the
documents have a negative weight: they add at most nothing to a bound, and count in full when a block is scored.

Positions count all words from 0, also those too short to count as terms. Null and empty texts are documents of length 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.index import Index, numbered
from docloom.operators.keyword import BOOST, K1, B
from docloom.operators.keyword import top_k as ranked

#: Documents of a block; blocks that a Python task matches at once; query terms up to which their names are pushed to the scan.
DOCS, GROUP, PUSHED = 128, 64, 1000
#: Bytes of the rows that a task sorts at once when it builds, and rows that it hands on at once.
RUN, ROWS = 48 << 20, 4096
#: Decimals of a score, so that sums in another order tie alike, and what bounds and scores may differ by.
DECIMALS, SLACK = 9, 2e-9

_DOCUMENTS = ("doc_ids", "dls", "n_words", "flags")
_LISTS = {"docs": pa.int16(), "tfs": pa.int32(), "gaps": pa.int32()}


@dataclass(frozen=True)
class Blocks:
    """postings: term, counted, block, n, technical, impacts, docs, tfs, gaps. documents: block, doc_ids, dls, n_words, flags. numbers: n, avgdl, mindl, maxdl."""

    postings: DataFrame
    documents: DataFrame
    numbers: DataFrame

    def index(self) -> Index:
        """The same index as rows of (term, doc_id, tf), decoded when they are read."""
        base = self.postings.where("counted").select("term", "block", F.explode(F.arrays_zip("docs", "tfs")).alias("x"))
        ids = self.documents.select("block", "doc_ids")
        rows = base.join(ids, "block").select("term", F.get("doc_ids", F.col("x.docs").cast("int")).alias("doc_id"), F.col("x.tfs").cast("long").alias("tf"))
        return Index(rows, self.lengths(), self.numbers, self.postings.where("counted").groupBy("term").agg(F.sum("n").alias("df")))

    def lengths(self) -> DataFrame:
        return self.documents.select(F.explode(F.arrays_zip("doc_ids", "dls", "flags")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.dls").cast("long").alias("dl"), F.col("x.flags").alias("technical"), F.col("x.dls").isNotNull().alias("there")).where("there").drop("there")


def invert(batch: pa.RecordBatch, block: int, least: int) -> pa.RecordBatch:
    """The rows of one block: a row for each term, and one without term for its documents. Columns: doc_id, terms, technical, n_words."""
    n, terms = batch.num_rows, batch.column(1)
    length = np.diff(np.asarray(terms.offsets))
    words = terms.flatten().dictionary_encode()
    code, names = np.asarray(words.indices, np.int64), words.dictionary
    counted = np.asarray(pc.greater_equal(pc.utf8_length(names), least)) if len(names) else np.zeros(0, bool)
    doc = np.repeat(np.arange(n), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    dl = np.bincount(doc, weights=counted[code], minlength=n).astype(np.int64)
    order = np.argsort(code, kind="stable")  # by term, then document, then position
    code, doc, place = code[order], doc[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf, term, at = np.diff(np.append(first, len(code))), code[first], doc[first]
    gap = np.diff(place, prepend=0)
    gap[first] = place[first]
    lead = np.flatnonzero(np.diff(term, prepend=-1))  # the first posting of each term
    size = np.diff(np.append(lead, len(term)))
    # impacts: by falling frequency, each document shorter than all before; terms' own ranges of values fall, so one running minimum serves all
    best = np.lexsort((dl[at], -tf, term))
    value = dl[at][best] - term[best] * (1 << 40)
    front = np.ones(len(best), bool)
    front[1:] = value[1:] < np.minimum.accumulate(value)[:-1]
    of = term[best][front]
    flags = np.asarray(batch.column(2))
    cut = lambda ends: np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
    lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(cut(ends)), pa.array(values.astype(kind.to_pandas_dtype())))
    impacts = pa.StructArray.from_arrays([pa.array(tf[best][front].astype(np.int32)), pa.array(dl[at][best][front].astype(np.int32))], names=["tf", "dl"])
    any_flag = np.logical_or.reduceat(flags[at], lead) if len(lead) else np.zeros(0, bool)
    per_term = [names.take(pa.array(term[lead])), pa.array(counted[term[lead]]), pa.array(np.full(len(lead), block)), pa.array(size.astype(np.int32)), pa.array(any_flag), pa.ListArray.from_arrays(pa.array(cut(np.bincount(of, minlength=len(names)) if len(names) else [])), impacts)]
    per_term += [lists(size, at, _LISTS["docs"]), lists(size, tf, _LISTS["tfs"]), lists(np.add.reduceat(tf, lead) if len(lead) else [], gap, _LISTS["gaps"])]
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
    own = [one(batch.column(0)), one(pa.array(dl.astype(np.int32))), one(batch.column(3)), one(batch.column(2))]
    rows = len(lead)
    cols = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in per_term] + [pa.concat_arrays([pa.nulls(rows, c.type), c]) for c in own]
    cols[2] = pa.array(np.full(rows + 1, block))
    return pa.RecordBatch.from_arrays(cols, names=["term", "counted", "block", "n", "technical", "impacts", "docs", "tfs", "gaps", "doc_ids", "dls", "n_words", "flags"])


def _sorted(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run: rows by term and block, those of documents at the end."""
    run = pa.Table.from_batches(made).combine_chunks()
    order = pc.sort_indices(run, sort_keys=[("term", "ascending"), ("block", "ascending")], null_placement="at_end")
    for at in range(0, len(order), ROWS):
        yield from run.take(order.slice(at, ROWS)).combine_chunks().to_batches()


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", content: str = "text", mode: str | None = "industrial", least: int = 2, technical: Column | None = None, block: int = DOCS) -> Blocks:
    """Writes the index of docs under path. mode None takes the words of the lower-cased text as they are.

    A table of fewer partitions than cores is dealt out by ranges of ids; larger ones stay as they are, so no texts are shuffled.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartitionByRange(cores, F.col(doc_id)).sortWithinPartitions(doc_id)
    text = F.lower(F.col(content)) if mode is None else tx.preprocess(F.col(content), mode)
    none, flag = F.array().cast("array<string>"), F.lit(False) if technical is None else F.coalesce(technical, F.lit(False))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tx.tokens(text, 1), none).alias("terms"), flag.alias("technical"), F.coalesce(F.size(tx.words(F.col(content))), F.lit(0)).alias("n_words"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                made.append(invert(batch.slice(at, block), number, least))
                number, size = number + 1, size + made[-1].nbytes
                if size >= RUN:
                    yield from _sorted(made)
                    made, size = [], 0
        if made:
            yield from _sorted(made)

    made = base.mapInArrow(run, f"term string, counted boolean, block long, n int, technical boolean, impacts array<struct<tf:int,dl:int>>, docs array<smallint>, tfs array<int>, gaps array<int>, doc_ids array<{kind}>, dls array<int>, n_words array<int>, flags array<boolean>")
    made.write.mode("overwrite").parquet(f"{path}/built")
    made = spark.read.schema(made.schema).parquet(f"{path}/built")
    made.where("term IS NULL").select("block", *_DOCUMENTS).write.mode("overwrite").parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    numbered(documents.select(F.explode(F.col("dls").cast("array<bigint>")).alias("dl"))).write.mode("overwrite").parquet(f"{path}/numbers")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Blocks:
    postings = spark.read.parquet(f"{path}/built").where("term IS NOT NULL").drop(*_DOCUMENTS)
    return Blocks(postings, *(spark.read.parquet(f"{path}/{t}") for t in ("documents", "numbers")))


def rows_of(blocks: Blocks, terms: DataFrame) -> DataFrame:
    """Postings of the terms (column term) only; where they are few their names reach the scan, which skips row groups."""
    named = [r.term for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(named) <= PUSHED:
        return blocks.postings.where(F.col("term").isin(named))
    return blocks.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass(frozen=True)
class Pruned:
    """scored: query_id, doc_id, raw, score of the documents of decoded blocks. bounds: query_id, block, rows, upper. decoded: query_id, block."""

    scored: DataFrame
    bounds: DataFrame
    decoded: DataFrame


def pruned(blocks: Blocks, terms: DataFrame, k: int = 5, k1: float = K1, b: float = B, boost: float = BOOST, probe: int | None = None) -> Pruned:
    """BM25 of the blocks that can hold one of the k best of a query (query_id, term; the caller's input, broadcast)."""
    q = terms.select("query_id", "term").distinct()
    rows = rows_of(blocks, q).where("counted")
    df = rows.groupBy("term").agg(F.sum("n").alias("df"))  # a row for each term of the queries
    n, d = F.col("total"), F.col("df")
    numbers = F.broadcast(blocks.numbers.select(F.col("n").alias("total"), "avgdl"))
    asked = q.join(df, "term").crossJoin(numbers).select("query_id", "term", "avgdl", F.log((n - d + 0.5) / (d + 0.5)).alias("idf"))
    peak = F.array_max(F.transform("impacts", lambda i: _weight(i["tf"], i["dl"], F.col("avgdl"), k1, b)))
    met = rows.select("term", "block", "technical", "impacts").join(F.broadcast(asked), "term")
    upper = met.groupBy("query_id", "block").agg(F.count("*").alias("rows"), (F.sum(F.greatest(F.lit(0.0), F.col("idf") * peak)) * F.when(F.bool_or("technical"), boost).otherwise(1.0) / 10.0).alias("upper"))
    least_id = blocks.documents.select("block", F.array_min("doc_ids").alias("least_id"))
    bounds = upper.withColumn("upper", F.least(F.lit(1.0), "upper")).where("upper > 0").join(least_id, "block")
    first = ranked(bounds, probe or max(1, k), score="upper", tie="least_id").select("query_id", "block")

    def score(some: DataFrame) -> DataFrame:
        hit = rows.select("term", "block", "docs", "tfs").join(some, "block").join(F.broadcast(asked), ["query_id", "term"]).join(blocks.documents.select("block", "doc_ids", "dls", "flags"), "block")
        at = lambda x: x["docs"].cast("int")
        each = F.transform(F.arrays_zip("docs", "tfs"), lambda x: F.struct(at(x).alias("at"), F.get("doc_ids", at(x)).alias("doc_id"), F.get("flags", at(x)).alias("technical"), (F.col("idf") * _weight(x["tfs"], F.get("dls", at(x)), F.col("avgdl"), k1, b)).alias("part")))
        raw = hit.select("query_id", "block", F.explode(each).alias("x")).groupBy("query_id", "block", "x.at").agg(F.first("x.doc_id").alias("doc_id"), F.first("x.technical").alias("technical"), F.sum("x.part").alias("raw"))
        raw = raw.withColumn("raw", F.col("raw") * F.when(F.col("technical"), boost).otherwise(1.0)).where("raw > 0")
        return raw.select("query_id", "doc_id", "raw", F.round(F.least(F.lit(1.0), F.col("raw") / 10.0), DECIMALS).alias("score"))

    sure = score(first)
    last = ranked(sure, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"), F.col("doc_id").alias("last_id"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(F.broadcast(last), "query_id", "left")  # a row for each query
    # a block that can only tie with the k-th score is of use if it has a smaller id
    useful = F.col("least").isNull() | (F.col("upper") > F.col("least") + SLACK) | ((F.col("upper") >= F.col("least") - SLACK) & (F.col("least_id") < F.col("last_id")))
    rest = rest.where(useful).select("query_id", "block")
    return Pruned(sure.unionByName(score(rest)), bounds, first.unionByName(rest))


def top_k(blocks: Blocks, terms: DataFrame, k: int = 5, **more) -> DataFrame:
    """query_id, doc_id, raw, score, rank: the rows of keyword.search() by BM25."""
    return ranked(pruned(blocks, terms, k, **more).scored, k)


def decoded(blocks: Blocks, terms: DataFrame, k: int = 5, **more) -> DataFrame:
    """query_id, rows (term rows of all blocks that a query could meet), decoded (of the blocks that were scored)."""
    p = pruned(blocks, terms, k, **more)
    seen = p.bounds.join(p.decoded.withColumn("seen", F.lit(True)), ["query_id", "block"], "left")
    return seen.groupBy("query_id").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("seen"), F.col("rows")).otherwise(0)).alias("decoded"))


def positions(docs: np.ndarray, tfs: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """doc << 32 | position of each place of a row, ascending."""
    total = np.cumsum(gaps)
    first = np.cumsum(tfs) - tfs
    before = np.repeat(total[first] - gaps[first], tfs)
    return (np.repeat(docs.astype(np.int64), tfs) << 32) | (total - before)


def _runs(starts: np.ndarray, size: int) -> np.ndarray:
    """Of ascending places those that a reader who goes on behind each match would find."""
    if size == 1 or not len(starts) or (np.diff(starts) >= size).all():
        return starts
    kept, free = [], -1
    for s in starts.tolist():
        if s >= free:
            kept.append(s)
            free = s + size
    return np.array(kept, np.int64)


def phrase_hits(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and how often, without overlaps, the words whose places are given stand one behind the other."""
    starts = lists[0]
    for i, places in enumerate(lists[1:], 1):
        if not len(starts):
            break
        starts = np.intersect1d(starts, places - i, assume_unique=True)
    return np.unique(_runs(starts, len(lists)) >> 32, return_counts=True)


def span_hits(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold all words, and the words of the shortest run of each that holds them all."""
    ends = np.unique(np.concatenate(lists))
    reach = np.zeros(len(ends), np.int64)
    for places in lists:
        at = np.searchsorted(places, ends)
        nxt = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], -1) if len(places) else np.full(len(ends), -1)
        reach = np.where((reach < 0) | (nxt < 0) | (nxt >> 32 != ends >> 32), -1, np.maximum(reach, nxt))
    ok = reach >= 0
    doc, span = ends[ok] >> 32, reach[ok] - ends[ok] + 1
    if not len(doc):
        return doc, span
    lead = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[lead], np.minimum.reduceat(span, lead)


def _matched(spark: SparkSession, blocks: Blocks, asked: dict[int, list[str]], fn) -> DataFrame:
    """key, doc_id, n_words, value, by fn over the lists of places of each key's words, block for block.

    Only blocks that hold every word of a key are decoded. A group is GROUP blocks in the order of their numbers.
    """
    rows = [(key, i, w) for key, words in asked.items() for i, w in enumerate(words)]
    words = F.broadcast(spark.createDataFrame(rows or [], "key int, at int, term string"))  # the caller's words
    size = F.broadcast(spark.createDataFrame([(k, len(set(w))) for k, w in asked.items()], "key int, distinct long"))
    of_term = words.select("key", "term").distinct()
    found = rows_of(blocks, words).select("term", "block", "docs", "tfs", "gaps")
    whole = found.select("term", "block").join(of_term, "term").groupBy("key", "block").agg(F.count("*").alias("have")).join(size, "key").where("have = distinct").select("block", "key")
    hit = found.join(of_term, "term").join(whole, ["block", "key"])
    lists = {k: list(w) for k, w in asked.items()}

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("block", "ascending")])
        key, block = np.asarray(table["key"]), np.asarray(table["block"])
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]), [True])))
        out: tuple[list, list, list, list] = ([], [], [], [])
        cols = {c: table[c].combine_chunks() for c in ("term", "docs", "tfs", "gaps")}
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            places = {cols["term"][r].as_py(): positions(*(np.asarray(cols[c][r].values) for c in ("docs", "tfs", "gaps"))) for r in range(s, e)}
            doc, value = fn([places[w] for w in lists[int(key[s])]])
            for o, v in zip(out, (np.full(len(doc), key[s]), np.full(len(doc), block[s]), doc, value), strict=True):
                o.append(v)
        cat = lambda v, kind: pa.array(np.concatenate(v).astype(kind) if v else np.zeros(0, kind))
        return pa.table([cat(out[0], np.int32), cat(out[1], np.int64), cat(out[2], np.int32), cat(out[3], np.int64)], names=["key", "block", "doc", "value"])

    got = hit.groupBy(F.floor(F.col("block") / GROUP).alias("group")).applyInArrow(match, "key int, block long, doc int, value long")
    docs = blocks.documents.select("block", "doc_ids", "n_words")
    return got.join(docs, "block").select("key", F.get("doc_ids", F.col("doc")).alias("doc_id"), F.get("n_words", F.col("doc")).alias("n_words"), "value")


def words_of(spark: SparkSession, texts: list[str], mode: str | None) -> list[list[str]]:
    """The texts' words as the index has them."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    text = F.lower("text") if mode is None else tx.preprocess(F.col("text"), mode)
    return [list(r.w) for r in rows.select("i", tx.tokens(text, 1).alias("w")).orderBy("i").collect()]


def phrases(blocks: Blocks, spark: SparkSession, queries: dict[int, list[str]], mode: str | None = None) -> DataFrame:
    """query_id, doc_id, score: of each query's phrases, occurrences over the phrase's words, summed, over hundredths of the text's words, at most 1.

    A phrase stands where its words follow each other, whatever stands between two words but letters, digits and underscores.
    """
    flat = [(q, p) for q, ps in queries.items() for p in ps]
    words = words_of(spark, [p for _, p in flat], mode)
    asked = {i: w for i, w in enumerate(words) if w}
    share = F.broadcast(spark.createDataFrame([(i, q, 1.0 / len(asked[i])) for i, (q, _) in enumerate(flat) if i in asked] or [], "key int, query_id int, share double"))
    found = _matched(spark, blocks, asked, phrase_hits).join(share, "key")
    raw = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("value") * F.col("share")).alias("raw"), F.first("n_words").alias("n_words"))
    return raw.where("n_words > 0").select("query_id", "doc_id", F.least(F.lit(1.0), F.col("raw") / (F.col("n_words") / 100.0)).alias("score"))


def near(blocks: Blocks, spark: SparkSession, queries: dict[int, str], window: int = 10, mode: str | None = None) -> DataFrame:
    """query_id, doc_id, span, score: documents with all words of a query within `window` words; span is the shortest such run, score the distinct words over it."""
    words = {q: list(dict.fromkeys(w)) for q, w in zip(queries, words_of(spark, list(queries.values()), mode), strict=True)}
    asked = {q: w for q, w in words.items() if w}
    found = _matched(spark, blocks, asked, span_hits).where(F.col("value") <= window)
    size = F.broadcast(spark.createDataFrame([(q, len(w)) for q, w in asked.items()] or [], "key int, distinct int"))
    return found.join(size, "key").select(F.col("key").alias("query_id"), "doc_id", F.col("value").alias("span"), (F.col("distinct") / F.col("value")).alias("score"))
