"""Structured Streaming: incremental index, windowed metrics, and sessions closed by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.index import Index
from docloom.operators.segments import SegmentedIndex


def ingest(stream: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Adds a segment for each micro-batch, once; a document that is sent again replaces what it was. how: as for SegmentedIndex."""
    index = SegmentedIndex(stream.sparkSession, path, **how)
    return stream.writeStream.foreachBatch(lambda batch, number: index.add(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_ingested(spark, path: str, **how) -> Index:
    return SegmentedIndex(spark, path, **how).index()


def windowed_metrics(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling, or with slide sliding, counts and sums by event_type; events later than `late` are dropped in a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_metrics(events: DataFrame, gap: str = "120 minutes", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def merged_sessions(parts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, n) of one user in any order, united where not more than gap lies between them: what the stream does, in plain Python."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(parts):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def closed_sessions(events: DataFrame, gap_minutes: int = 120, late: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """user_id, session_start, last_event, n, of each session once the watermark has passed its end; of streams only.

    Native session windows: no Python and no call for each user; the state is a row for each open session, and goes when it is closed.
    Times are kept a microsecond late, so a session whose gap ends at the watermark itself stays open.
    Events come in any order within `late`; those whose own window the watermark has passed are dropped, which a query's progress counts
    (late_rows). Events without user or time are left out.
    """
    e = events.select(F.col(user).cast("long").alias("user_id"), F.col(ts).cast("timestamp").alias("ts")).where("user_id IS NOT NULL AND ts IS NOT NULL")
    moved = lambda c, us: F.timestamp_micros(F.unix_micros(c) + us)
    w = F.session_window("ts", f"{gap_minutes} minutes")
    out = e.withColumn("ts", moved(F.col("ts"), 1)).withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return out.select("user_id", moved(F.col("w.start"), -1).alias("session_start"), moved(F.col("last_event"), -1).alias("last_event"), "n")


def run_sessions(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends closed sessions to path from what is there, once; run again with the same checkpoint it goes on where it ended."""
    return closed_sessions(events, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, in the progress that the query still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
