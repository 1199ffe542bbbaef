"""What the query modules share: table access, rounding, and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(text: str, words) -> str:
    """Whether text contains any of the words."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")" if words else "false"


def sql_hits(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2)"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def sql_values(columns: str, rows: list[tuple]) -> str:
    """A relation of literal rows, as SQL."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({columns})"
