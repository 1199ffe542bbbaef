"""Intermediate tables in the folder that driver and executors share; they cut lineage, so a lost executor costs the tasks of one step."""

from __future__ import annotations

import atexit
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.session import shared_dir

_LOG = logging.getLogger(__name__)


class Files:
    """Small files in a folder, by Hadoop's file system, local or not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Whole or not at all."""
        draft = self._path(f"{self.root}/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.root}/{name}")):
            raise OSError(f"cannot write {self.root}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Tables:
    """Named Parquet tables of one call, removed when the process ends or when they are dropped."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/docloom-{owner}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Removes a table, or all of them; what is read from it must have been written elsewhere."""
        if self.spark.sparkContext._jsc is None:  # the session has ended, and Spark's own folders with it
            return
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as e:  # noqa: BLE001  py4j's errors have no common class; a folder that stays does no harm to results
            _LOG.warning("%s/%s stays: %s", self.root, name, e)
