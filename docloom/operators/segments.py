"""An index that grows: immutable segments of positional postings, versions of documents, deletions, tiered merges.

A batch of documents becomes a segment; a document sent again is dead in the segments before, and so is a deleted one.
Nothing is rewritten for that: each segment lists the ids that it overrides, and readers leave out dead documents of the blocks
that have any. When `fan` neighbouring segments of like size have come together they are merged into one, without their
dead documents. A manifest names the segments of a state; it is put in place when all is written, and a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import blocks as bl
from docloom.operators.index import Index, numbered
from docloom.tables import Files

#: Bits of a block's number within its segment, and neighbouring segments of like size that are merged.
BLOCK_BITS, FAN = 47, 4
_POSTINGS = ["term", "counted", "block", "n", "technical", "impacts", "docs", "tfs", "gaps"]


class SegmentedIndex(Files):
    def __init__(self, spark: SparkSession, root: str, doc_id: str = "doc_id", content: str = "text", mode: str | None = None, least: int = 2, technical: Column | None = None, fan: int = FAN, version: str | None = None):
        """version: a column that tells which of a batch's rows of one id is the last; without one, the greatest row is."""
        super().__init__(spark, root)
        self.doc_id, self.content, self.fan, self.version = doc_id, content, fan, version
        self.how = {"doc_id": doc_id, "content": content, "mode": mode, "least": least, "technical": technical}

    def state(self) -> dict:
        found = [n for n in self.names() if n.startswith("m")]
        return json.loads(self.read(found[-1])) if found else {"state": 0, "last": -1, "next": 0, "segments": []}

    def _put(self, now: dict) -> None:
        now = now | {"state": now["state"] + 1}
        self.put(f"m{now['state']:020d}", json.dumps(now))
        old = [n for n in self.names() if n.startswith("m")]
        for n in old[:-2]:
            self.delete(n)
        used = {s["name"] for n in old[-2:] for s in json.loads(self.read(n))["segments"]}
        for n in self.names():
            if n.startswith("seg-") and n not in used and int(n[4:]) < now["next"]:
                self.delete(n)

    def add(self, docs: DataFrame, number: int) -> bool:
        """A segment of the batch of this number; False if it, or a later one, was added before."""
        return self._change(docs, docs.select(self.doc_id), number)

    def remove(self, ids: DataFrame, number: int) -> bool:
        """Deletes documents by id."""
        return self._change(None, ids.select(self.doc_id), number)

    def _change(self, docs: DataFrame | None, ids: DataFrame, number: int) -> bool:
        now = self.state()
        if number <= now["last"]:
            return False
        name = f"seg-{now['next']:010d}"
        count = 0
        if docs is not None:
            bl.build(self._latest(docs), f"{self.root}/{name}", **self.how)
            count = self.spark.read.parquet(f"{self.root}/{name}/numbers").first()["n"]
        ids.select(F.col(self.doc_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.root}/{name}/ids")
        made = {"name": name, "offset": now["next"] << BLOCK_BITS, "docs": count}
        self._put(now | {"last": number, "next": now["next"] + 1, "segments": [*now["segments"], made]})
        self._merge()
        return True

    def _latest(self, docs: DataFrame) -> DataFrame:
        """One row of each id; rows without id are documents of their own."""
        named = docs.where(F.col(self.doc_id).isNotNull())
        if named.count() == named.select(self.doc_id).distinct().count():
            return docs
        order = F.struct(*([F.col(self.version)] if self.version else []), *(F.col(c) for c in docs.columns))
        last = named.groupBy(self.doc_id).agg(F.max_by(F.struct(*docs.columns), order).alias("x")).select("x.*")
        return last.unionByName(docs.where(F.col(self.doc_id).isNull()))

    def _table(self, s: dict, name: str) -> DataFrame:
        path = f"{self.root}/{s['name']}"
        # a batch's postings stand where its build has left them; merged ones, and those of older indexes, have a table of their own
        built = name == "postings" and self._fs.exists(self._path(f"{path}/built"))
        t = bl.load(self.spark, path).postings if built else self.spark.read.parquet(f"{path}/{name}")
        return t.withColumn("block", F.col("block") + F.lit(s["offset"])) if "block" in t.columns else t

    def _all(self, segments: list[dict], name: str) -> DataFrame | None:
        held = [self._table(s, name).withColumn("seg", F.lit(i)) for i, s in enumerate(segments) if name == "ids" or s["docs"]]
        return reduce(DataFrame.unionByName, held) if held else None

    def _dead(self, segments: list[dict]) -> DataFrame:
        """block, dead: places of documents whose id a later segment lists."""
        last = self._all(segments, "ids").groupBy("doc_id").agg(F.max("seg").alias("last"))
        here = self._all(segments, "documents").select("seg", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
        return here.join(last, "doc_id").where("last > seg").groupBy("block").agg(F.collect_list(F.col("place").cast("int")).alias("dead"))  # a block's documents at most

    def _alive(self, segments: list[dict]) -> tuple[DataFrame, DataFrame] | None:
        """postings and documents without what is dead; a dead document's place in its block has neither id nor length."""
        documents, postings = self._all(segments, "documents"), self._all(segments, "postings")
        if documents is None:
            return None
        dead = self._dead(segments)
        gone = lambda x, i: F.when(F.array_contains(F.col("dead"), i), F.lit(None)).otherwise(x)
        marked = documents.join(dead, "block", "left")
        documents = marked.withColumns({c: F.when(F.col("dead").isNull(), F.col(c)).otherwise(F.transform(c, gone)) for c in ("doc_ids", "dls")}).select("seg", "block", "doc_ids", "dls", "n_words", "flags")
        whole = postings.join(dead.select("block"), "block", "left_anti").select(*_POSTINGS)
        part = postings.join(dead, "block").select(*_POSTINGS, "dead")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
        return whole.unionByName(part.mapInArrow(_purged, kinds)), documents

    def blocks(self) -> bl.Blocks:
        """What is alive, for pruned search, phrases and proximity."""
        now = self.state()
        alive = self._alive(now["segments"])
        if alive is None:
            raise KeyError(f"no documents in {self.root}")
        documents = alive[1].drop("seg")
        return bl.Blocks(alive[0], documents, numbered(bl.Blocks(alive[0], documents, documents).lengths()))

    def index(self) -> Index:
        return self.blocks().index()

    def _merge(self) -> None:
        """Merges the last `fan` neighbours of which none is more than `fan` times as large as another, while there are any."""
        while True:
            now = self.state()
            size = [max(s["docs"], 1) for s in now["segments"]]
            at = next((i for i in range(len(size) - self.fan, -1, -1) if max(size[i : i + self.fan]) <= self.fan * min(size[i : i + self.fan])), None)
            if at is None:
                return
            # documents are dead by all later segments, also those that are not merged
            some, name = now["segments"][at : at + self.fan], f"seg-{now['next']:010d}"
            path, count = f"{self.root}/{name}", 0
            alive = self._alive(now["segments"][at:])
            if alive is not None:
                own = alive[1].where(F.col("seg") < self.fan).drop("seg").where(F.exists("dls", lambda x: x.isNotNull()))
                own.write.mode("overwrite").parquet(f"{path}/documents")
                documents = self.spark.read.parquet(f"{path}/documents")
                alive[0].join(documents.select("block"), "block", "left_semi").select(*_POSTINGS).write.mode("overwrite").parquet(f"{path}/loose")
                loose = self.spark.read.parquet(f"{path}/loose")
                loose.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
                self.delete(f"{name}/loose")
                count = documents.agg(F.sum(F.size(F.filter("dls", lambda x: x.isNotNull())))).first()[0] or 0
            self._all(some, "ids").select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/ids")
            made = {"name": name, "offset": 0, "docs": count}
            self._put(now | {"next": now["next"] + 1, "segments": [*now["segments"][:at], made, *now["segments"][at + self.fan :]]})


def _purged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the documents at their dead places; rows of dead documents only go. Impacts stay: they bound what is left too."""
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        size, lost = (np.diff(np.asarray(col[n].offsets)) for n in ("docs", "dead"))
        docs, tfs, gaps, dead = (np.asarray(col[n].flatten()) for n in ("docs", "tfs", "gaps", "dead"))
        row = np.arange(batch.num_rows)
        keep = ~np.isin(np.repeat(row, size) << 20 | docs.astype(np.int64), np.repeat(row, lost) << 20 | dead.astype(np.int64))
        left = np.bincount(np.repeat(row, size)[keep], minlength=batch.num_rows)
        places = np.bincount(np.repeat(row, size)[keep], weights=tfs[keep], minlength=batch.num_rows).astype(np.int64)
        cut = lambda ends: pa.array(np.concatenate(([0], np.cumsum(ends))).astype(np.int32))
        new = {
            "n": pa.array(left.astype(np.int32)),
            "docs": pa.ListArray.from_arrays(cut(left), pa.array(docs[keep])),
            "tfs": pa.ListArray.from_arrays(cut(left), pa.array(tfs[keep])),
            "gaps": pa.ListArray.from_arrays(cut(places), pa.array(gaps[np.repeat(keep, tfs)])),
        }
        out = pa.RecordBatch.from_arrays([new.get(n, col[n]) for n in _POSTINGS], names=_POSTINGS)
        yield out.filter(pa.array(left > 0))
