"""Registered queries: operation statistics, health, sessions, paging, windowed metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import fusion
from docloom.operators import monitor as mo
from docloom.plans.common import long, r6, table
from docloom.streaming import streams
from docloom.tables import Tables


def _events(spark, sf):
    return table(spark, sf, "events")




def op_stats(spark, sf):
    s = mo.operation_stats(_events(spark, sf), "event_type", F.col("value") > 20, F.round(F.abs("value") * 100).cast("long"))
    return s.select("event_type", "n", "n_ok", "total_ms", r6("avg_ms").alias("avg_ms"), r6("success_percent").alias("success_percent"), r6("per_second").alias("per_second"))


def status_histogram(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def state_changes(spark, sf):
    return mo.state_changes(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type").select("user_id", "changes", "n")


def running_average(spark, sf):
    e = _events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return mo.running_average(e, "user_id", ["ts", "event_id"], "cents").select("event_id", r6("running_avg").alias("running_avg"))


def throughput_score(spark, sf):
    a = _events(spark, sf).groupBy("user_id").agg(F.sum(F.round(F.abs("value") * 100).cast("long")).alias("c"), F.count("*").alias("n"), F.sum((F.col("event_type") != "error").cast("long")).alias("ok"))
    return a.select("user_id", r6(mo.throughput_score(F.col("c") / F.col("n") / 1000.0, F.col("ok") / F.col("n"))).alias("score"))


def performance_alerts(spark, sf):
    a = _events(spark, sf).groupBy(F.col("user_id").alias("key")).agg((F.sum((F.col("event_type") != "error").cast("long")) / F.count("*")).alias("success"), (F.sum(F.round(F.abs("value") * 100).cast("long")) / F.count("*") / 50.0).alias("avg_s"), (F.count("*") / 20.0).alias("load"))
    return mo.performance_alerts(a)


def component_health(spark, sf):
    names = F.array(*map(F.lit, mo.LIMITS))
    m = _events(spark, sf).select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("component"), F.abs("value").alias("value"))
    return mo.component_health(m).groupBy("component", "status").agg(F.count("*").alias("n"))


def overall_status(spark, sf):
    states = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "signup", "degraded").otherwise("healthy")
    return mo.overall_status(_events(spark, sf).select("user_id", states.alias("status")), ["user_id"]).select("user_id", "n_components", "status")


def sessionize(spark, sf):
    return mo.sessions(_events(spark, sf)).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n")


def session_states(spark, sf):
    s = mo.sessions(_events(spark, sf))
    return mo.session_states(s, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("state", "sessions", "events")


def exception_counts(spark, sf):
    e = _events(spark, sf).select("ts", F.get_json_object("props", "$.page").alias("page"), F.col("event_type").alias("type"))
    return mo.exception_stats(e)[0].select("type", "n")


def filter_search_page(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return mo.page(mo.search_rows(c, "build"), ["c_mktsegment", "c_custkey"], 2)


def paged_parts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return mo.page(p, [F.desc("p_size"), "p_partkey"], 3, 25)


def formatted(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", mo.file_size(F.col("n_chars")).alias("size"))
    return d


def log_filter(spark, sf):
    e = _events(spark, sf).select("ts", F.col("event_type").alias("level"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").cast("string").alias("message"))
    return mo.filter_logs(e, "error", "USER-1", 25).select("message", "source")


def availability(spark, sf):
    e = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "unhealthy").otherwise("healthy").alias("status"))
    return mo.summary(e, 24, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("n", r6("availability").alias("availability"))


def adaptation_stats(spark, sf):
    w = (F.col("event_id") % 10 + 1) / 10.0
    log = _events(spark, sf).select("event_id", F.col("event_id").alias("ts"), w.alias("vector_weight"), (1 - w).alias("keyword_weight"), (F.col("user_id") % 7).alias("results"))
    s = fusion.adaptation_stats(log)
    return s.select("queries", "vector_dominant", "keyword_dominant", r6("avg_vector_weight").alias("avg_vector_weight"), r6("avg_results").alias("avg_results"))


def windowed_metrics(spark, sf):
    e = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))
    return streams.windowed_metrics(e, "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


#: Days of a batch of streamed_sessions, and its last batch.
SLICE_DAYS, LAST_SLICE = 5, 5


def _sliced(spark, sf):
    """Events with the batch (`file`) that brings them: that of their time, the next for half of those at its end, one three on for every 97th."""
    e = _events(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.crossJoin(F.broadcast(e.agg(F.unix_micros(F.min("ts")).alias("low"))))
    size = SLICE_DAYS * 86_400_000_000
    own = F.least(F.floor((F.unix_micros("ts") - F.col("low")) / size), F.lit(LAST_SLICE))
    edge = (F.unix_micros("ts") - F.col("low")) % size >= size - 1_800_000_000
    file = F.when((F.col("event_id") % 97 == 0) & (own + 3 <= LAST_SLICE), own + 3).when(edge & (F.col("event_id") % 2 == 0) & (own < LAST_SLICE), own + 1).otherwise(own)
    return e.withColumn("file", file.cast("int")).drop("low")


def streamed_sessions(spark, sf):
    """Sessions closed by a stream over the events in six batches, stopped after each and started again from its checkpoint; a batch has as many files as tasks wrote."""
    t, e = Tables(spark, "stream"), _sliced(spark, sf)
    at, out, checkpoint = (f"{t.root}/{n}" for n in ("in", "out", "checkpoint"))
    for f in range(LAST_SLICE + 1):
        e.where(F.col("file") == f).drop("file").write.mode("append").parquet(at)
        stream = spark.readStream.schema(e.drop("file").schema).parquet(at)
        streams.run_sessions(stream, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    return got.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n")


def label_filter(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("quality = 1 AND toxic = 0")
    return d.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def top_customers(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return o.orderBy(F.desc("cents"), "o_custkey").limit(20).select("o_custkey", "n", "cents")


QUERIES = [streamed_sessions, op_stats, status_histogram, state_changes, running_average, throughput_score, performance_alerts, component_health, overall_status, sessionize, session_states, exception_counts, filter_search_page, paged_parts, formatted, log_filter, availability, adaptation_stats, windowed_metrics, label_filter, top_customers]

_CENTS = "CAST(round(abs(value) * 100) AS BIGINT)"
_SESSIONS = """s0 AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s0),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n FROM s1 GROUP BY user_id, s)"""
_LIMIT = "CASE component " + " ".join(f"WHEN '{n}' THEN CASE WHEN value >= {c} THEN 'critical' WHEN value >= {w} THEN 'degraded' ELSE 'healthy' END" for n, (w, c) in mo.LIMITS.items()) + " END"
_STREAMED = _SESSIONS.replace("FROM events WINDOW", "FROM kept WINDOW")
SQL = {
    # rows three files late are dropped; sessions that the last watermark, an hour before the last event, has not passed are open
    "streamed_sessions": f"""WITH low AS (SELECT min(epoch_us(ts)) AS low FROM events),
kept AS (SELECT events.* FROM events, low WHERE NOT (event_id % 97 = 0 AND least((epoch_us(ts) - low) // {SLICE_DAYS * 86_400_000_000}, {LAST_SLICE}) + 3 <= {LAST_SLICE})),
{_STREAMED} SELECT * FROM s WHERE epoch_us(last_event) + 7200000000 < (SELECT max(epoch_us(ts)) - 3600000000 FROM kept)""",
    "op_stats": f"""SELECT event_type, count(*) AS n, CAST(count(*) FILTER (value > 20) AS BIGINT) AS n_ok, CAST(sum({_CENTS}) AS BIGINT) AS total_ms, round(avg({_CENTS}), 6) + 0.0 AS avg_ms,
round(count(*) FILTER (value > 20) * 100.0::DOUBLE / count(*), 6) + 0.0 AS success_percent, round(count(*) * 1000.0::DOUBLE / sum({_CENTS}), 6) + 0.0 AS per_second FROM events GROUP BY event_type""",
    "status_histogram": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
    "state_changes": "SELECT user_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS changes, count(*) AS n FROM (SELECT user_id, CAST(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS c FROM events) GROUP BY user_id",
    "running_average": "SELECT event_id, round(avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running_avg FROM events",
    "throughput_score": f"SELECT user_id, round((greatest(0, 100 - 10 * (sum({_CENTS})::DOUBLE / count(*) / 1000.0::DOUBLE)) + 100 * (count(*) FILTER (event_type <> 'error')::DOUBLE / count(*))) / 2, 6) + 0.0 AS score FROM events GROUP BY user_id",
    "performance_alerts": f"""WITH a AS (SELECT user_id AS key, count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) AS success, sum({_CENTS})::DOUBLE / count(*) / 50.0::DOUBLE AS avg_s, count(*) / 20.0::DOUBLE AS load FROM events GROUP BY user_id)
SELECT key, 'success_rate' AS kind, CASE WHEN success < 0.5 THEN 'high' ELSE 'medium' END AS severity FROM a WHERE success < 0.8
UNION ALL SELECT key, 'slow', CASE WHEN avg_s > 180 THEN 'high' ELSE 'medium' END FROM a WHERE avg_s > 60 UNION ALL SELECT key, 'load', 'high' FROM a WHERE load > 0.9""",
    "component_health": f"SELECT component, status, count(*) AS n FROM (SELECT component, {_LIMIT} AS status FROM (SELECT ['cpu', 'memory', 'disk', 'response_s', 'error_rate'][event_id % 5 + 1] AS component, abs(value) AS value FROM events)) GROUP BY ALL",
    "overall_status": """WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'signup' THEN 'degraded' ELSE 'healthy' END AS st FROM events)
SELECT user_id, count(*) AS n_components, CASE WHEN count(*) FILTER (st = 'unhealthy') >= 2 THEN 'unhealthy' WHEN count(*) FILTER (st = 'unhealthy') = 1 OR count(*) FILTER (st = 'degraded') > 0 THEN 'degraded' WHEN count(*) FILTER (st = 'healthy') = count(*) THEN 'healthy' ELSE 'degraded' END AS status FROM s GROUP BY user_id""",
    "sessionize": f"WITH {_SESSIONS} SELECT * FROM s",
    "session_states": f"""WITH {_SESSIONS}, a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_event)) / 60000000.0::DOUBLE AS age FROM s)
SELECT CASE WHEN age < 120 THEN 'active' ELSE 'idle' END AS state, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM a WHERE age <= 1440 GROUP BY 1""",
    "exception_counts": "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1",
    "filter_search_page": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'build') OR contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') ORDER BY c_mktsegment, c_custkey LIMIT 10 OFFSET 10",
    "paged_parts": "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 50",
    "formatted": "SELECT doc_id, CASE WHEN n_chars < 1024 THEN format('{} B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(n_chars / 1048576.0::DOUBLE, 1)) END AS size FROM documents",
    "log_filter": "SELECT CAST(event_id AS VARCHAR) AS message, 'user-' || user_id AS source FROM events WHERE event_type = 'error' AND contains('user-' || user_id, 'user-1') ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 25",
    "availability": "SELECT count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 100.0::DOUBLE ELSE 0 END), 6) + 0.0 AS availability FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'",
    "adaptation_stats": """SELECT count(*) AS queries, CAST(count(*) FILTER (w > 0.6) AS BIGINT) AS vector_dominant, CAST(count(*) FILTER (1 - w > 0.6) AS BIGINT) AS keyword_dominant, round(avg(w), 6) + 0.0 AS avg_vector_weight, round(avg(user_id % 7), 6) + 0.0 AS avg_results
FROM (SELECT *, (event_id % 10 + 1) / 10.0::DOUBLE AS w FROM events ORDER BY event_id DESC LIMIT 1000)""",
    "windowed_metrics": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
    "label_filter": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY lang",
    "top_customers": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1 ORDER BY cents DESC, o_custkey LIMIT 20",
}
