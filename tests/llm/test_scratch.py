"""Intermediate tables leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch


def shuffle_files(spark):
    return {f for f in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "/shuffle_" in f}


def test_a_steps_shuffle_files_go_with_the_step(spark):
    """Disk holds the shuffles of one step; before, those of all steps stayed until a garbage collection."""
    before = shuffle_files(spark)
    Scratch(spark, "swept").table("t", spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    till = time.time() + 20
    while shuffle_files(spark) - before and time.time() < till:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
