"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
and Spark runs inside one machine (``local[...]``, as in tests) a temporary folder stands in.
A table written here cuts the lineage: a lost executor costs the tasks of one step, not of all.
Nothing reads a step's shuffles after its table is written, so their files go with the step.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docloom.session import shared_dir

_SCOPES: list[list[Scratch]] = []
#: Files of a table of few, for each task that runs at once.
FEW = 4
#: Spark's setting that removes a query's shuffle files when the query ends, not when the driver's garbage collector finds them unused.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each ends, so that disk holds those of one step and not of all."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom-{owner}-{uuid.uuid4().hex}"
        atexit.register(self.close)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def table(self, name: str, df: DataFrame, few: bool = False) -> DataFrame:
        """Writes df and returns it as read back. few: rows are narrow, so tasks take several shuffle partitions one after another and write fewer files."""
        path = f"{self.root}/{name}"
        if few:
            df = df.coalesce(FEW * self.spark.sparkContext.defaultParallelism)
        with swept(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all tables; what is read from them must have been written elsewhere."""
        self._remove(self.root)
        atexit.unregister(self.close)

    def _remove(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end the tables of every operator called inside, whose results must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for made in _SCOPES.pop():
            made.close()
