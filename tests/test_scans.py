"""Running values and looks at the row before over ranges, and sessions closed by a stream's timers."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import monitor, scan
from docloom.plans import monitoring
from docloom.streaming import streams


def logs(n, seed, keys):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), rng.randrange(50), i, rng.choice([None, *range(20)])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def ordered(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))


SCHEMA = "k string, t int, i int, v long"


@pytest.mark.parametrize(("keys", "ranges"), [(["a"], 7), (["a", "b", None, "c"], 5), (list("abcdefghij"), 1), (["a"] * 9 + list("bcd"), 40)])
def test_running_values_against_plain_python(spark, keys, ranges):
    rows = logs(300, ranges, keys)
    df = spark.createDataFrame(rows, SCHEMA)
    want_sum, want_before = {}, {}
    for key in set(keys):
        total, n, before = 0, 0, "none"
        for r in ordered(rows, key):
            total, n = total + (r[3] or 0), n + (r[3] is not None)
            want_sum[r[2]], want_before[r[2]] = (total, n), before
            before = r[3]
    assert {r.i: (r.running_sum, r.running_n) for r in scan.running(df, ["k"], ["t", "i"], "v", ranges).collect()} == want_sum
    assert {r.i: "none" if r["first"] else r.before for r in scan.previous(df, ["k"], ["t", "i"], "v", ranges).collect()} == want_before


def test_one_order_over_all_rows(spark):
    rows = logs(200, 3, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(rows, key=lambda r: (r[1], r[2]))
    changes = sum(a[0] != b[0] for a, b in zip(whole, whole[1:], strict=False))
    got = monitor.state_changes(df, None, ["t", "i"], "k")
    assert tuple(got.first()) == (changes, 200)
    summary = monitor.metric_summary(df.select(F.timestamp_seconds(F.lit(1_000_000) + F.col("t")).alias("ts"), F.col("k").alias("provider"), F.when(F.col("v") > 5, "healthy").otherwise("degraded").alias("status"), "i"), 1, F.timestamp_seconds(F.lit(1_000_100)), ["ts", "i"]).first()
    assert summary.provider_changes == changes and summary.n == 200
    assert scan.running(df.limit(0), ["k"], ["t"], "v").count() == scan.previous(df.limit(0), [], ["t"], "v").count() == 0


def test_no_task_takes_a_whole_key(spark):
    """All rows have one key; the local windows stand over ranges."""
    df = spark.range(10_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = scan.running(df, ["k"], ["t"], "v", 8)
    assert got.where("running_sum <> t * (t + 1) / 2 OR running_n <> t + 1").count() == 0
    per = scan._ranged(df, ["k"], ["t"], 8).groupBy("_part").count().collect()
    assert len(per) == 8 and max(r["count"] for r in per) < 3000


def test_merged_sessions():
    parts = [(10, 10, 1), (0, 0, 1), (25, 30, 2), (14, 14, 1), (50, 50, 1)]
    assert streams.merged_sessions(parts, 5) == [(0, 0, 1), (10, 14, 2), (25, 30, 2), (50, 50, 1)]
    assert streams.merged_sessions([*parts, (20, 20, 1)], 6) == [(0, 0, 1), (10, 30, 5), (50, 50, 1)]
    assert streams.merged_sessions([], 5) == []


def test_stream_of_sessions_with_late_rows_and_a_restart(spark, tmp_path):
    """Minutes from a start; a gap of 10 and a lateness of 30. Rows without user or time, users without an end, a bridge between two sessions."""
    start = 1_700_000_000
    files = [
        [(1, 0), (1, 8), (2, 5), (None, 3), (3, None), (1, 30)],
        [(1, 20), (2, 60), (2, 55), (1, 100)],  # 20 stands between 8 and 30 without reaching either
        [(1, 22), (1, 28), (3, 200)],  # late by then
        [(1, 190), (1, 181), (4, 10), (3, 209)],  # out of order, and one far too late
        [(5, 400)],
    ]
    at, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    late = 0
    for i, rows in enumerate(files):
        minutes = [(i, u, None if m is None else start + 60 * m) for u, m in rows]
        spark.createDataFrame(minutes, "file int, user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(at)
        if i in (1, 4):
            stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at)
            q = streams.run_sessions(stream, out, checkpoint, gap_minutes=10, late="30 minutes")
            q.awaitTermination()
            late += streams.late_rows(q)
    got = spark.read.parquet(out).select("user_id", ((F.unix_seconds("session_start") - start) / 60).cast("int"), ((F.unix_seconds("last_event") - start) / 60).cast("int"), "n").collect()
    # the watermark ends at 370, so user 5 is still open
    assert sorted(map(tuple, got)) == [(1, 0, 8, 2), (1, 20, 30, 2), (1, 100, 100, 1), (1, 181, 190, 2), (2, 5, 5, 1), (2, 55, 60, 2), (3, 200, 209, 2)]
    assert late == 3


def test_stream_of_sessions_is_native_and_keeps_what_ends_at_the_watermark_open(spark, tmp_path):
    at, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, 0), (1, 600), (2, 59), (3, 60), (4, 660 + 1800)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).write.parquet(at)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(at)
    plan = streams.closed_sessions(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Python" not in plan  # a Python worker for each partition and batch took the time
    streams.run_sessions(stream, out, checkpoint, gap_minutes=10, late="30 minutes").awaitTermination()
    got = spark.read.parquet(out).select("user_id", F.unix_micros("session_start"), F.unix_micros("last_event"), "n").collect()
    assert sorted(map(tuple, got)) == [(2, 59_000_000, 59_000_000, 1)]  # those of users 1 and 3 end at 1200 and 660, the watermark is 660


def test_query_drops_what_is_late(spark, sf):
    kept = monitoring._sliced(spark, sf)
    assert kept.where("event_id % 97 = 0").agg(F.count_if(F.col("file") >= 3)).first()[0] > 0
