"""Operation statistics, health, alerts, sessions: conditional aggregates and windows over event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import scan


def operation_stats(log: DataFrame, by: str, ok: Column, ms: Column) -> DataFrame:
    """Of each operation: n, n_ok, total and mean time, success in percent, operations a second."""
    a = log.groupBy(by).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_ok"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_ms"))
    return a.withColumn("success_percent", F.col("n_ok") * 100.0 / F.col("n")).withColumn("per_second", F.when(F.col("total_ms") > 0, F.col("n") * 1000.0 / F.col("total_ms")))


def running_average(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with the mean of the value over its key's rows so far; one huge key is scanned by ranges."""
    r = scan.running(df, [key], order, value)
    return r.withColumn("running_avg", F.when(F.col("running_n") > 0, F.col("running_sum") / F.col("running_n"))).drop("running_sum", "running_n")


def throughput_score(avg_s: Column, success: Column) -> Column:
    return (F.greatest(F.lit(0.0), 100 - 10 * avg_s) + 100 * success) / 2


def performance_alerts(stats: DataFrame) -> DataFrame:
    """Rows (key, kind, severity) from columns key, success, avg_s, load."""
    some = [F.when(F.col("success") < 0.5, F.struct(F.lit("success_rate").alias("kind"), F.lit("high").alias("severity"))).when(F.col("success") < 0.8, F.struct(F.lit("success_rate").alias("kind"), F.lit("medium").alias("severity")))]
    some.append(F.when(F.col("avg_s") > 180, F.struct(F.lit("slow").alias("kind"), F.lit("high").alias("severity"))).when(F.col("avg_s") > 60, F.struct(F.lit("slow").alias("kind"), F.lit("medium").alias("severity"))))
    some.append(F.when(F.col("load") > 0.9, F.struct(F.lit("load").alias("kind"), F.lit("high").alias("severity"))))
    return stats.select("key", F.explode(F.array_compact(F.array(*some))).alias("a")).select("key", "a.kind", "a.severity")


def state_changes(log: DataFrame, key: str | None, order: list[str], state: str) -> DataFrame:
    """How often the state differs from the row before, of each key or in the whole log; one huge key is scanned by ranges."""
    keys = [key] if key else []
    changed = scan.previous(log, keys, order, state).withColumn("changed", (F.col(state) != F.col("before")).cast("long"))
    return changed.groupBy(*keys).agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"), F.count("*").alias("n"))


def threshold_status(value: Column, warn: float, critical: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= critical, "critical").when(value >= warn, "degraded").otherwise("healthy")


LIMITS = {"cpu": (70.0, 90.0), "memory": (80.0, 95.0), "disk": (85.0, 95.0), "response_s": (5.0, 15.0), "error_rate": (0.05, 0.20)}


def component_health(metrics: DataFrame) -> DataFrame:
    """metrics (component, value) with status by LIMITS; unknown components have no limits."""
    out = F.lit("unknown")
    for name, (warn, critical) in LIMITS.items():
        out = F.when(F.col("component") == name, threshold_status(F.col("value"), warn, critical)).otherwise(out)
    return metrics.withColumn("status", out)


def overall_status(components: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One status from those of components (column status)."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    n = F.count("*")
    status = F.when(n == 0, "unknown").when(count("critical") > 0, "critical").when(count("unhealthy") >= 2, "unhealthy").when((count("unhealthy") == 1) | (count("degraded") > 0), "degraded").when(count("healthy") == n, "healthy").otherwise("degraded")
    return components.groupBy(*(by or [])).agg(n.alias("n_components"), status.alias("status"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", idle_minutes: int = 120) -> DataFrame:
    """user, session_start, last_event, n: events less than idle_minutes apart belong together."""
    w = W.partitionBy(user).orderBy(ts)
    new = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w) > idle_minutes * 60_000_000).cast("int"), F.lit(1))
    marked = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(user, "_s").agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count("*").alias("n")).drop("_s")


def session_states(sessions_: DataFrame, now: Column, idle_minutes: int = 120, expiry_hours: int = 24) -> DataFrame:
    """Counts of active and idle sessions; expired ones are left out. Columns: last_event, n."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_event").cast("timestamp"))) / 60_000_000.0
    s = sessions_.withColumn("state", F.when(age > expiry_hours * 60, "expired").when(age < idle_minutes, "active").otherwise("idle"))
    return s.where("state <> 'expired'").groupBy("state").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def summary(log: DataFrame, hours: int, now: Column, status: str = "status") -> DataFrame:
    """Over the last hours: rows, and the share of healthy ones in percent."""
    recent = log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return recent.agg(F.count("*").alias("n"), F.avg((F.col(status) == "healthy").cast("double") * 100).alias("availability"))


def metric_summary(log: DataFrame, hours: int, now: Column, order: list[str], status: str = "status", provider: str = "provider") -> DataFrame:
    """Over the last hours: rows, share of healthy ones in percent, a histogram of states (map), and changes of provider in the given order."""
    recent = log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    states = recent.groupBy(status).agg(F.count("*").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "c")))).alias("states"))
    changes = state_changes(recent, None, order, provider).select(F.col("changes").alias("provider_changes"))
    return summary(log, hours, now, status).crossJoin(states).crossJoin(changes)  # a row each


def stage_timing(log: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """Of each stage: runs, mean time, and its share of all time in percent."""
    a = log.groupBy(stage).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms"), F.sum(ms).alias("total_ms"))
    return a.withColumn("percent", F.when(F.sum("total_ms").over(W.partitionBy()) > 0, F.col("total_ms") * 100.0 / F.sum("total_ms").over(W.partitionBy())).otherwise(0.0))


Check = Callable[[SparkSession], tuple[str, float | None]]
CHECKS: dict[str, Check] = {}


def register_check(name: str, check: Check) -> None:
    """A further health check: a function of the session to a status and a value."""
    CHECKS[name] = check


def run_checks(spark: SparkSession, checks: dict[str, Check] | None = None) -> DataFrame:
    """component, status, value, error: a row for each check; one that fails is unhealthy with its error."""
    rows = []
    for name, check in (CHECKS if checks is None else checks).items():
        try:
            status, value = check(spark)
            rows.append((name, status, None if value is None else float(value), None))
        except Exception as e:  # noqa: BLE001  a failing check is a result
            rows.append((name, "unhealthy", None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "component string, status string, value double, error string")


def exception_stats(errors: DataFrame, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by type, and the last rows. Columns: ts, type."""
    return errors.groupBy("type").agg(F.count("*").alias("n")), errors.orderBy(F.desc("ts"), "type").limit(last)


def filter_logs(log: DataFrame, level: str | None = None, source: str | None = None, most: int = 100) -> DataFrame:
    """The newest rows (ts, level, source, message) of a level and of sources that contain a text."""
    out = log
    if level:
        out = out.where(F.col("level") == level)
    if source:
        out = out.where(F.contains(F.lower("source"), F.lit(source.lower())))
    return out.orderBy(F.desc("ts"), "message").limit(most)


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    """Page `number` (from 1) of an ordered table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows any of whose columns contains the term, whatever its case."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    return df.where(hit)


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2)).otherwise(F.format_string("%.1f GB", n / 1024.0**3))


def duration(s: Column) -> Column:
    return F.when(s < 1, F.format_string("%.0fms", s * 1000)).when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fmin", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))
