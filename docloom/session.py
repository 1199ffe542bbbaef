"""Session defaults, and getting this package to the Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, name: str = "docloom", **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and those that plans profit from (AQE)."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for an application; they may not have it installed."""
    if spark.conf.get(_BATCH, "64MB") in ("67108864", "67108864b", "64MB"):
        spark.conf.set(_BATCH, "8MB")  # texts may be long: what a worker holds at once is bounded by bytes, not rows
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="docloom-src-"), "docloom_src.zip")
        Path(path).write_bytes(buf.getvalue())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it has fewer partitions than there are; as it is otherwise, so large tables are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getConf().get("spark.checkpoint.dir", "")
    if not named and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="docloom-"))
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")
