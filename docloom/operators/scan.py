"""Running sums and looks at the row before, over orders of any length, also that of one huge key.

Rows are sorted by key and order into ranges, written with the number of their range, and scanned range by range. A key
that goes on over several ranges takes up in each what the ranges before have left: a row for each range and key that
spans ranges, twice the number of ranges at most, which is broadcast. No task holds more than a range, whatever
the keys. The order must be total where results depend on ties. Nulls in keys are one key; in values they count for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.tables import Tables

_PART = "_part"


def _ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """df with the number of its range, written: boundaries are drawn once."""
    by = [F.col(c) for c in [*keys, *order]]
    sorted_ = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return Tables(df.sparkSession, "scan").write("ranges", sorted_.withColumn(_PART, F.spark_partition_id()))


def _left_over(rows: DataFrame, keys: list[str], what: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """Of each range and key that spans ranges what the ranges before leave, by `before` over the ranges' own values `what`."""
    per = rows.groupBy(_PART, *keys).agg(*(c.alias(n) for n, c in what.items()))
    span = per.groupBy(*keys).agg(F.min(_PART).alias("_first"), F.max(_PART).alias("_last")).where(F.col("_first") < F.col("_last")).drop("_first", "_last")
    many = per.join(span, _same(per, span, keys), "left_semi") if keys else per
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    return many.select(_PART, *keys, *(c.over(w).alias(n) for n, c in before.items()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def _joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    named = carry.select(F.col(_PART).alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in carry.columns if c != _PART and c not in keys))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col(_PART) == F.col("_p"))
    return rows.join(F.broadcast(named), on, "left").drop("_p", *(f"_k{i}" for i in range(len(keys))))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """df with running_sum and running_n of the value, up to each row of its key."""
    rows = _ranged(df, keys, order, ranges)
    total = {"_sum": F.coalesce(F.sum(value), F.lit(0)), "_n": F.count(value)}
    carry = _left_over(rows, keys, total, {"_sum": F.sum("_sum"), "_n": F.sum("_n")})
    here = W.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({"running_sum": F.coalesce(F.sum(value).over(here), F.lit(0)), "running_n": F.count(value).over(here)})
    out = _joined(local, carry, keys)
    return out.withColumns({"running_sum": F.col("running_sum") + F.coalesce("_sum", F.lit(0)), "running_n": F.col("running_n") + F.coalesce("_n", F.lit(0))}).drop("_sum", "_n", _PART)


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, ranges: int | None = None) -> DataFrame:
    """df with `before`, the column's value in the row before of the same key (null in the first), and `first`, whether there is none."""
    rows = _ranged(df, keys, order, ranges)
    last = {"_last": F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order))}
    carry = _left_over(rows, keys, last, {"_last": F.last("_last", ignorenulls=True)})
    here = W.partitionBy(_PART, *keys).orderBy(*order)
    local = rows.withColumn("_here", F.lag(F.struct(F.col(column).alias("v"))).over(here))
    out = _joined(local, carry, keys).withColumn("_here", F.coalesce("_here", "_last"))
    return out.withColumns({"before": F.col("_here.v"), "first": F.col("_here").isNull()}).drop("_here", "_last", _PART)
