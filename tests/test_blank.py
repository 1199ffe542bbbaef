"""Documents without text, or of blanks only: the queries' rows are those of their SQL."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare, connection

BLANK = [None, "", "   ", "　 ", "\t\n", " " * 300, " Des eau  "]
HASHED = ["fuse_one_sided", "hash_embedding_knn", "mmr", "mmr_strategy", "semantic_search", "semantic_strategy", "shape_rerank"]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("odd")
    for f in Path(sf).iterdir():
        if f.name != "documents.parquet":
            os.symlink(f, out / f.name)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(BLANK * 2)], "doc_id long, text string")
    more = more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs.unionByName(more).coalesce(1).write.parquet(f"{out}/written")
    os.symlink(next((out / "written").glob("*.parquet")), out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", [*HASHED, "enrich_documents", "enrichment_with_blanks"])
def test_blank_documents(spark, odd, name):
    compare(entry.queries()[name](spark, odd), entry.oracle_sql()[name], connection(odd))
