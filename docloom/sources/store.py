"""A store of document collections on Parquet: add, upsert, delete, get, list, info, reset, backup; merged when it is read.

A collection is a folder of data folders and of manifests, one for each version. A change writes what changes and nothing
else: rows go to a delta folder, and the keys they replace, or that are deleted, to a folder of deletions, both divided into
hash buckets of the key. Rows and deletions carry the number of the version that wrote them; a row is alive unless its
key was deleted by a later version, which is resolved when the collection is read. compact() rewrites the buckets in which
deltas and deletions weigh most, and leaves the others. A manifest lists the folders of its version with the buckets of each that count.

Versions are numbered. A writer claims the number after the one that it has read; of two writers one gets it, and the other
raises WriteConflict, removes what it wrote and leaves the collection as the first one made it. The claim is an exclusive create, which
is as atomic as the file system makes it (HDFS: yes; a local disk: but for a moment). A manifest is renamed into place when it is whole, so
readers see whole versions. A claim whose writer died is void after `patience` seconds. Paths go through Hadoop's file system.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash buckets of a collection, folders after which a change compacts, and the share of deltas from which a bucket is worth rewriting.
BUCKETS, FOLDERS, SHARE = 16, 24, 0.25


class WriteConflict(RuntimeError):
    """Another writer made the version that this one meant to make; nothing of this one stays."""


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str, key: str = "id", allow_reset: bool = False, keep: int = 2, buckets: int = BUCKETS, folders: int = FOLDERS, patience: float = 3600.0):
        self.spark, self.root, self.key, self.allow_reset, self.keep = spark, root.rstrip("/"), key, allow_reset, keep
        self.buckets, self.folders, self.patience = buckets, folders, patience
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _versions(self, name: str) -> list[str]:
        return [n for n in self._names(f"{self.root}/{name}") if n.startswith("v")]

    def _manifest(self, name: str, version: str | None = None) -> dict:
        versions = self._versions(name)
        if not versions:
            raise KeyError(name)
        return json.loads(self._read(f"{self.root}/{name}/{version or versions[-1]}"))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """A small file, whole or not at all."""
        draft = self._path(f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if not self._fs.rename(draft, self._path(path)):
            raise OSError(f"cannot write {path}")

    def _claim(self, name: str, version: int) -> bool:
        """Whether this writer may make the version."""
        path = self._path(f"{self.root}/{name}/_claim-{version:020d}")
        if self._fs.exists(path) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > self.patience:
            self._fs.delete(path, False)
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:
            if self._fs.exists(path):
                return False
            raise
        return max(self._versions(name), default="") < f"v{version:020d}"

    def list(self) -> list[str]:
        return [n for n in self._names(self.root) if self._versions(n)]

    def _bucket(self, df: DataFrame, buckets: int) -> Column:
        """Of rows without the key, which can be added but not replaced, the first."""
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int") if self.key in df.columns else F.lit(0)

    def _folder(self, name: str, rows: DataFrame, version: int, kind: str, buckets: int) -> dict:
        """Writes rows by bucket, large buckets in several files, and gives the manifest's entry."""
        folder = f"d{version:020d}-{kind}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{name}/{folder}"
        rows.withColumn("_bucket", self._bucket(rows, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        held = self.spark.read.schema("_bucket int").parquet(path).groupBy("_bucket").count().collect()  # a row for each bucket
        return {"folder": folder, "version": version, "kind": kind, "rows": {str(r._bucket): r["count"] for r in held}}

    def _open(self, name: str, manifest: dict, kind: str, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of a kind with the version that wrote them, of all or of some buckets; None where there are none."""
        paths = [f"{self.root}/{name}/{e['folder']}/_bucket={b}" for e in manifest["entries"] if e["kind"] == kind for b in e["rows"] if buckets is None or int(b) in buckets]
        if not paths:
            return None
        schema = StructType.fromJson(manifest["schema"])
        if kind == "deletes":
            schema = StructType([schema[self.key]])
        return self.spark.read.schema(schema.add("_version", "long")).parquet(*paths)

    def _alive(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        rows, gone = (self._open(name, manifest, k, buckets) for k in ("data", "deletes"))
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"]).add("_version", "long"))
        if gone is None:
            return rows
        last = gone.groupBy(F.col(self.key).alias("_key")).agg(F.max("_version").alias("_gone"))
        return rows.join(last, (F.col(self.key) == F.col("_key")) & (F.col("_version") < F.col("_gone")), "left_anti")

    def get_all(self, name: str) -> DataFrame:
        return self._alive(name, self._manifest(name)).drop("_version")

    def _commit(self, name: str, before: dict | None, rows: DataFrame | None, deleted: DataFrame | None = None, anew: bool = False) -> None:
        """The version after `before`: its folders (none, if anew) and those of the rows and deletions."""
        version, buckets = (before["version"] if before else 0) + 1, before["buckets"] if before and not anew else self.buckets
        schema = rows.schema.jsonValue() if rows is not None and (anew or not before) else before["schema"]
        wanted = lambda df: df.withColumn("_version", F.lit(version).cast("long"))
        made = []
        if deleted is not None:
            made.append(self._folder(name, wanted(deleted.select(self.key).distinct()), version, "deletes", buckets))
        if rows is not None:
            made.append(self._folder(name, wanted(rows), version, "data", buckets))
        kept = [] if anew or not before else before["entries"]
        self._publish(name, version, {"created": before["created"] if before else time.time_ns(), "version": version, "buckets": buckets, "schema": schema, "entries": [e for e in [*kept, *made] if e["rows"]]}, made)

    def _publish(self, name: str, version: int, manifest: dict, made: list[dict]) -> None:
        if not self._claim(name, version):
            for e in made:
                self._fs.delete(self._path(f"{self.root}/{name}/{e['folder']}"), True)
            raise WriteConflict(f"{name}: version {version} is another writer's")
        self._put(f"{self.root}/{name}/v{version:020d}", json.dumps(manifest))
        versions = self._versions(name)
        for old in versions[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
        used = {e["folder"] for v in versions[-self.keep :] for e in self._manifest(name, v)["entries"]}
        for n in self._names(f"{self.root}/{name}"):
            # folders of later versions are other writers'; claims up to this one are spent, but the last ones tell late writers
            if (n.startswith("d") and n not in used and int(n[1:21]) <= version) or (n.startswith("_claim-") and int(n[7:]) < version - self.keep):
                self._fs.delete(self._path(f"{self.root}/{name}/{n}"), True)

    def _current(self, name: str) -> dict | None:
        return self._manifest(name) if self._versions(name) else None

    def create(self, name: str, rows: DataFrame) -> None:
        """A collection of these rows, or its next version, without any of the rows before."""
        self._commit(name, self._current(name), rows, anew=True)

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends rows, without touching those that are there; a new collection if there is none."""
        self._change(name, rows, None)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of their keys. Writes the rows and their keys."""
        self._change(name, rows, rows)

    def delete(self, name: str, ids: DataFrame) -> None:
        """Writes the keys."""
        self._change(name, None, ids)

    def _change(self, name: str, rows: DataFrame | None, deleted: DataFrame | None) -> None:
        before = self._current(name)
        if before is None and deleted is not None:
            raise KeyError(name)
        if before is not None and rows is not None:
            kinds = StructType.fromJson(before["schema"])
            rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in kinds))
        if before is not None and deleted is not None:
            deleted = deleted.select(F.col(self.key).cast(StructType.fromJson(before["schema"])[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull())
        self._commit(name, before, rows, deleted)
        if before is not None and len(before["entries"]) >= self.folders:
            self.compact(name)

    def compact(self, name: str, share: float = SHARE) -> list[int]:
        """Rewrites, with what is alive, the buckets in which rows and deletions of later folders are at least `share` of the first one's; gives their numbers."""
        before = self._manifest(name)
        base: dict[str, int] = {}
        more: dict[str, int] = {}
        for e in before["entries"]:
            for b, n in e["rows"].items():
                if b in base or e["kind"] == "deletes":
                    more[b] = more.get(b, 0) + n
                else:
                    base[b] = n
        wanted = {int(b) for b in more if more[b] >= share * base.get(b, 0)}
        if not wanted:
            return []
        version = before["version"] + 1
        made = self._folder(name, self._alive(name, before, wanted).withColumn("_version", F.lit(version).cast("long")), version, "data", before["buckets"])
        left = [e | {"rows": {b: n for b, n in e["rows"].items() if int(b) not in wanted}} for e in before["entries"]]
        self._publish(name, version, before | {"version": version, "entries": [e for e in [*left, made] if e["rows"]]}, [made])
        return sorted(wanted)

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        """Rows of the keys, from their buckets only."""
        manifest = self._manifest(name)
        wanted = ids.select(F.col(self.key).cast(StructType.fromJson(manifest["schema"])[self.key].dataType).alias(self.key)).distinct()
        buckets = {r.b for r in wanted.select(self._bucket(wanted, manifest["buckets"]).alias("b")).distinct().collect()}  # at most one row a bucket
        return self._alive(name, manifest, buckets).drop("_version").join(wanted, self.key, "left_semi")

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def reset(self) -> bool:
        return self.allow_reset and all(self.drop(n) for n in self.list())

    def info(self, name: str, embedding: str | None = None) -> DataFrame:
        """count, dimension, bytes, created."""
        df, m = self.get_all(name), self._manifest(name)
        dim = F.max(F.size(embedding)) if embedding else F.lit(None).cast("int")
        return df.agg(F.count("*").alias("count"), dim.alias("dimension")).withColumns({"bytes": F.lit(self.bytes(name)), "created": F.timestamp_micros(F.lit(m["created"] // 1000))})

    def bytes(self, name: str) -> int:
        """Of all folders that the current version reads from."""
        return sum(self._size(f"{self.root}/{name}/{e['folder']}/_bucket={b}") for e in self._manifest(name)["entries"] for b in e["rows"])

    def _size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength())

    def backup(self, name: str, to: str) -> str:
        """Writes the current version under `to`, with metadata.json beside the rows, and gives its path."""
        now = time.time_ns()
        path, df = f"{to.rstrip('/')}/{name}-{now:020d}", self.get_all(name)
        df.write.parquet(f"{path}/data")
        self._put(f"{path}/metadata.json", json.dumps({"collection": name, "backup_ns": now, "created_ns": self._manifest(name)["created"], "count": self.spark.read.parquet(f"{path}/data").count(), "columns": df.dtypes}))
        return path

    def restore(self, path: str, name: str) -> None:
        """A collection, or its next version, from a backup."""
        self.create(name, self.spark.read.parquet(f"{path}/data"))

    def backups(self, at: str, name: str | None = None) -> list[tuple[str, float]]:
        """Backups, the newest first, with their size in MB."""
        found = [n for n in self._names(at) if name is None or n.rsplit("-", 1)[0] == name]
        return [(n, round(self._size(f"{at.rstrip('/')}/{n}") / 1e6, 3)) for n in sorted(found, key=lambda n: n.rsplit("-", 1)[1], reverse=True)]


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key new has not, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def flatten_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scalars as they are (null texts empty), anything else as JSON."""
    out = df
    for c in columns:
        kind = dict(df.dtypes)[c]
        value: Column = F.col(c)
        if kind.startswith(("array", "struct", "map")):
            value = F.coalesce(F.to_json(c), F.lit(""))
        elif kind == "string":
            value = F.coalesce(value, F.lit(""))
        out = out.withColumn(c, value)
    return out


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def import_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("x")).select("x.*")
