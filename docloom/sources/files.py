"""Files as rows: text and binary sources with validation, metadata, ids, cleanup; loaders by extension; extractors are pluggable.

A plain PDF reader (pdf.py) is registered; better ones can be put before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import pdf

#: Columns of a table of files. Largest file, and what is read as what. Fixed values.
FILES = "path string, modified timestamp, size long, content binary"
MAX_BYTES = 50 * 1024 * 1024
MIME = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def read(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """path, modified, size, content (bytes): a scan of files; size and time filters reach it before contents are read. It skips empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def validate(files: DataFrame, extensions: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """files with `reject`: why a file is not loaded, or null. Unknown extensions are read as text unless `extensions` says which to take."""
    size = F.col("size")
    checks = F.when(size.isNull(), "not found").when(size <= 0, "empty").when(size > most, "too large")
    return files.withColumn("reject", checks if extensions is None else checks.when(~extension(F.col("path")).isin(extensions), "unsupported"))


def decode_text(content: Column, encoding: str | None = None) -> Column:
    """The bytes as text: the given encoding, else UTF-8, else Latin-1, which always succeeds."""
    utf8 = F.when(F.is_valid_utf8(F.decode(content, "ISO-8859-1")), F.try_validate_utf8(content.cast("string")))
    latin = F.decode(content, "ISO-8859-1")
    return F.coalesce(F.decode(content, encoding), latin) if encoding else F.coalesce(utf8, latin)


def clean_extracted(text: Column) -> Column:
    """Lines trimmed; blank ones, short bare numbers and stray marks go; at most one blank line in a row."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & ~(x.rlike(r"^[0-9]+$") & (F.length(x) < 5)) & ~((F.length(x) < 3) & ~x.rlike(r"^[\p{L}\p{N}]+$")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, block ends as line feeds, tags dropped, common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|title)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, value in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(value))
    return F.regexp_replace(t, r"[ \t]+", " ")


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS to an ISO timestamp; shorter forms count from the start of what they leave out; null if invalid."""
    digits = F.regexp_extract(value, r"^(?:D:)?(\d{4,14})", 1)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    return F.when(F.length(digits) >= 4, F.date_format(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss"))


Extractor = Callable[[bytes], tuple[str, dict[str, str]]]
EXTRACTORS: dict[str, list[Extractor]] = {".pdf": [pdf.extract]}


def register_extractor(ext: str, fn: Extractor, first: bool = False) -> None:
    """A further way to read files of this extension; ways are tried in order until one gives text."""
    EXTRACTORS.setdefault(ext.lower(), []).insert(0 if first else len(EXTRACTORS.get(ext.lower(), [])), fn)


def formats() -> dict[str, str]:
    """Extensions and the type that each is read as."""
    return {**{e: "application/octet-stream" for e in EXTRACTORS}, **MIME}


def extract(files: DataFrame, ext: str) -> DataFrame:
    """path, text, info (map), error, and what else the files have but their bytes: through the registered extractors of ext, one Arrow batch at a time."""
    chain = list(EXTRACTORS.get(ext.lower(), []))

    def one(raw: bytes) -> tuple[str | None, dict[str, str], str | None]:
        last = "no extractor"
        for fn in chain:
            try:
                text, info = fn(raw)
                if text.strip():
                    return text, info, None
                last = "no text"
            except Exception as e:  # noqa: BLE001  the next way is tried and the last failure reported
                last = f"{type(e).__name__}: {e}"
        return None, {}, last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(bytes(raw)) for raw in b["content"]]
            yield b.drop(columns="content").assign(text=[g[0] for g in got], info=[g[1] for g in got], error=[g[2] for g in got])

    mine = files.where(extension(F.col("path")) == ext.lower())
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.schema if f.name != "content")
    return mine.mapInPandas(run, f"{kept}, text string, info map<string,string>, error string")


def load(spark: SparkSession, *paths: str, encoding: str | None = None, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, path, name, extension, mime, size, modified, sha256, text, info, n_chars, n_words) and rejects (path, reject)."""
    conf = spark._jsc.hadoopConfiguration()
    there, missing = [], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        (there if p.getFileSystem(conf).globStatus(p) else missing).append(path)
    files = spark.createDataFrame([(p, None, None, None) for p in missing], FILES)
    return load_files(files.unionByName(read(spark, *there)) if there else files, encoding, most)


def load_files(files: DataFrame, encoding: str | None = None, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """load() of files as read() or from_bytes() give them."""
    files = validate(files, most=most)
    good = files.where("reject IS NULL").withColumn("sha", F.sha2("content", 256))  # so that no bytes come back from an extractor
    text, ext = decode_text(F.col("content"), encoding), extension(F.col("path"))
    none = F.create_map().cast("map<string,string>")
    docs = good.where(~ext.isin(*EXTRACTORS)).withColumn("text", F.when(ext.isin(".html", ".htm"), clean_extracted(html_text(text))).otherwise(text)).withColumn("info", none).drop("content")
    rejects = files.where("reject IS NOT NULL").select("path", "reject")
    for kind in EXTRACTORS:
        got = extract(good, kind)
        docs = docs.unionByName(got.where("error IS NULL").withColumn("text", clean_extracted(F.col("text"))).drop("error"))
        rejects = rejects.unionByName(got.where("error IS NOT NULL").select("path", F.col("error").alias("reject")))
    return describe(docs), rejects


def describe(docs: DataFrame) -> DataFrame:
    sha = F.col("sha")
    mime = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    name, ext = file_name(F.col("path")), extension(F.col("path"))
    doc_id = F.concat_ws("_", name, F.left(sha, F.lit(8)), F.left(F.md5(F.col("text").cast("binary")), F.lit(8)))
    return docs.select(doc_id.alias("doc_id"), "path", name.alias("name"), ext.alias("extension"), F.coalesce(F.try_element_at(mime, ext), F.lit("application/octet-stream")).alias("mime"), "size", "modified", sha.alias("sha256"), "text", "info", F.length("text").alias("n_chars"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_words"))


def from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """Files held in memory, as read() gives them, with upload:// paths."""
    rows = [(f"upload://{k}", None, len(v), bytearray(v)) for k, v in named.items()]
    return spark.createDataFrame(rows, FILES)


def identifier(path: Column, content: Column) -> Column:
    """The path, else 16 digits of the content's MD5, else unknown_source."""
    return F.coalesce(F.nullif(path, F.lit("")), F.left(F.md5(content.cast("binary")), F.lit(16)), F.lit("unknown_source"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """source_id (text_ and 8 digits of the MD5), content."""
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    return df.select(F.concat(F.lit("text_"), F.left(F.md5(F.col("content").cast("binary")), F.lit(8))).alias("source_id"), "content")
