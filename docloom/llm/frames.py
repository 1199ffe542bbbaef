"""Small helpers that the operators share: column choice, fresh names, Arrow maps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.words import PIECE, pieces
from docloom.session import spread


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Just these columns, renamed and cast: new_name=(old_name, type). Other columns cannot clash with them."""
    return df.select(*(F.col(f"`{old}`").cast(kind).alias(new) for new, (old, kind) in columns.items()))


def map_texts(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = PIECE) -> DataFrame:
    """fn over slices of about `most` bytes of df's Arrow batches; whole rows, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, most):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
