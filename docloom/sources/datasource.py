"""Files as a Spark data source: `spark.read.format("docloom_files")` after register(), and `df.write` the other way.

Rows have the columns of files.FILES and the file's name and extension, so files.load_files() takes them as they
are. Against the binary file source it plans by bytes (small files share a partition, each counted with a cost for
opening it), keeps empty files, reads no file that is too large to be loaded, and takes conditions on path, name,
extension, size and time that drop files before they are planned. File systems are those that Arrow opens by URI.

Conditions belong to the call of read(), not to later filters of its rows: in Spark 4.1 all uses of one DataFrame share
what a Python source was given by pushFilters, so that a use without a filter got the rows of one with it. Later filters are Spark's.

Options: path; where (JSON list of [column, comparison, value], all of which hold); partition_bytes; max_bytes (a larger file comes
without content, so that validation rejects it). Listing happens on the driver, as for any file source: names and sizes, no contents.

Defined results: files and folders whose names begin with `.` or `_` are skipped; a path that is one file gives that file; a folder
without files gives no rows; a path that does not exist is an error. Writing takes the columns path (relative, inside the
folder) and content: a null content makes an empty file, a null path or one that leads out of the folder is an error, of rows with one
path one stays, other columns are ignored. Each file gets its name when it is whole, so a repeated task writes the same files again.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from operator import contains, eq, ge, gt, le, lt, ne

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from docloom.sources.files import MAX_BYTES

NAME = "docloom_files"
SCHEMA = "path string, name string, extension string, modified timestamp, size long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("size", pa.int64()), ("content", pa.binary())])
#: Bytes a partition may hold, what opening a file counts as, and bytes in one Arrow batch.
PARTITION_BYTES, OPEN_BYTES, BATCH_BYTES = 32 << 20, 64 << 10, 8 << 20
Condition = tuple[str, str, object]
#: What conditions may compare, and how.
COLUMNS = ("path", "name", "extension", "size", "modified")
COMPARISONS: dict[str, Callable[[object, object], bool]] = {
    "=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge, "contains": contains,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
    "startswith": lambda a, b: a.startswith(b), "endswith": lambda a, b: a.endswith(b),
}


def extension_of(name: str) -> str:
    """As files.extension(): what follows the last point, which may come first in a name; lower case."""
    at = name.rfind(".")
    return name[at:].lower() if 0 <= at < len(name) - 1 else ""


def conditions(text: str) -> list[Condition]:
    """The option `where`: unknown columns or comparisons are errors, times are ISO texts (UTC where no zone is given)."""
    out = []
    for column, how, value in json.loads(text):
        if column not in COLUMNS or how not in COMPARISONS:
            raise ValueError(f"no such condition: {column} {how}")
        many = how in ("in", "not in")
        values = value if many else [value]
        if column == "modified":
            values = [t if t.tzinfo else t.replace(tzinfo=UTC) for t in map(datetime.fromisoformat, values)]
        wanted = int if column == "size" else datetime if column == "modified" else str
        if not all(isinstance(v, wanted) for v in values) or (wanted is not str and how in ("contains", "startswith", "endswith")):
            raise ValueError(f"{column} {how} {value!r} can't be compared")
        out.append((column, how, values if many else values[0]))
    return out


@dataclass
class Part(ds.InputPartition):
    """Files read by one task: (path on the file system, path shown, modified, size)."""

    files: tuple[tuple[str, str, object, int], ...]


def packed(files: Iterable[tuple[str, str, object, int]], most: int, opening: int = OPEN_BYTES) -> list[Part]:
    """Partitions of about `most` bytes in the order of paths; a file is never split."""
    parts: list[Part] = []
    held: list[tuple[str, str, object, int]] = []
    total = 0
    for f in files:
        if held and total + f[3] + opening > most:
            parts.append(Part(tuple(held)))
            held, total = [], 0
        held.append(f)
        total += f[3] + opening
    return [*parts, Part(tuple(held))] if held else parts


class FileReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("no path given")
        self.root = options["path"].rstrip("/")
        self.where = conditions(options.get("where", "[]"))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[Part]:
        system, top = pafs.FileSystem.from_uri(self.root)
        info = system.get_file_info(top)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        single = info.type == pafs.FileType.File
        found = [info] if single else system.get_file_info(pafs.FileSelector(top, recursive=True))
        files = []
        for i in found:
            below = "" if single else i.path[len(top.rstrip("/")) + 1 :]
            if i.type != pafs.FileType.File or any(p[0] in "._" for p in below.split("/") if p):
                continue
            shown, name = f"{self.root}/{below}" if below else self.root, posixpath.basename(i.path)
            row = {"path": shown, "name": name, "extension": extension_of(name), "size": i.size, "modified": i.mtime}
            if all(COMPARISONS[how](row[column], value) for column, how, value in self.where):
                files.append((i.path, shown, i.mtime, i.size))
        return packed(sorted(files, key=lambda f: f[1]), self.partition_bytes)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        system, _ = pafs.FileSystem.from_uri(self.root)
        rows: list[tuple] = []
        held = 0
        for path, shown, modified, size in partition.files:
            content = None
            if size <= self.max_bytes:
                with system.open_input_stream(path) as f:
                    content = f.read()
            name = posixpath.basename(path)
            rows.append((shown, name, extension_of(name), modified, size, content))
            held += size if content is not None else 0
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Written(ds.WriterCommitMessage):
    files: int


class FileWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("files are added, or replaced by name: use mode append")
        if "path" not in options:
            raise ValueError("no path given")
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = pafs.FileSystem.from_uri(self.root)
        made: set[str] = set()
        n = 0
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                if not name or name.startswith("/") or name.endswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a path inside the folder: {name!r}")
                target = f"{top}/{name}"
                folder = posixpath.dirname(target)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                whole = f"{folder}/.writing-{uuid.uuid4().hex}"
                with system.open_output_stream(whole) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                system.move(whole, target)
                n += 1
        return Written(n)


class FileSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to the session. The workers need this package (session.ship)."""
    spark.dataSource.register(FileSource)
    return spark


def read(spark: SparkSession, path: str, where: Iterable[Condition] = (), **options: object) -> DataFrame:
    """Files below path for which all conditions hold, for files.load_files(). Times may be datetimes."""
    given = json.dumps([(c, how, v) for c, how, v in where], default=lambda t: t.isoformat())
    return register(spark).read.format(NAME).option("where", given).options(**options).load(path)


def write(files: DataFrame, path: str) -> None:
    """A file for each row of (path, content)."""
    register(files.sparkSession)
    files.select("path", "content").write.format(NAME).mode("append").save(path)


def remove(path: str) -> None:
    """The folder and all in it."""
    system, top = pafs.FileSystem.from_uri(path.rstrip("/"))
    system.delete_dir(top)
