import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import index
from docloom.plans.common import table
from docloom.sources import config, datasource, files
from docloom.sources.store import CollectionStore, WriteConflict, export_json, import_json
from docloom.streaming import streams


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hallo welt")
    (tmp_path / "b.md").write_bytes("größe".encode("latin-1"))
    (tmp_path / "c.xyz").write_text("x")
    (tmp_path / "e.html").write_text("<p>Hi &amp; <b>you</b></p><script>no</script>")
    docs, rejects = files.load(spark, str(tmp_path))
    got = {r.name: r for r in docs.collect()}
    assert got["a.txt"].text == "hallo welt" and got["a.txt"].n_words == 2 and got["a.txt"].doc_id.startswith("a.txt_")
    assert got["b.md"].text == "größe" and "Hi &" in got["e.html"].text and "no" not in got["e.html"].text
    assert got["c.xyz"].text == "x" and rejects.count() == 0
    assert files.validate(files.from_bytes(spark, {"d.txt": b"", "f.txt": b"x" * 9}), most=5).select("reject").collect() == [("empty",), ("too large",)]


def test_extractors_try_in_order(spark, monkeypatch):
    monkeypatch.setattr(files, "EXTRACTORS", {})

    def broken(raw):
        raise ValueError("no")

    files.register_extractor(".pdf", broken)
    files.register_extractor(".pdf", lambda raw: (raw.decode(), {"pages": "1"}))
    got = files.extract(files.from_bytes(spark, {"x.pdf": b"inhalt"}), ".pdf").first()
    assert (got.text, got.info, got.error) == ("inhalt", {"pages": "1"}, None)


def test_store(spark, tmp_path):
    s = CollectionStore(spark, str(tmp_path / "store"), allow_reset=True)
    mk = lambda rows: spark.createDataFrame(rows, "id int, v string")
    s.create("c", mk([(1, "a"), (2, "b")]))
    s.add("c", mk([(3, "c")]))
    s.upsert("c", mk([(2, "B"), (4, "d")]))
    s.delete("c", mk([(1, "")]))
    assert {r.id: r.v for r in s.get_all("c").collect()} == {2: "B", 3: "c", 4: "d"}
    assert [r.v for r in s.get("c", mk([(4, "")])).collect()] == ["d"] and s.list() == ["c"] and s.info("c").first()["count"] == 3
    s.backup("c", str(tmp_path / "backup"))
    assert len(s.backups(str(tmp_path / "backup"), "c")) == 1
    s.create("keyless", spark.createDataFrame([("x",), ("y",)], "v string"))
    s.add("keyless", spark.createDataFrame([("z",)], "v string"))
    assert sorted(r.v for r in s.get_all("keyless").collect()) == ["x", "y", "z"]
    assert s.reset() and s.list() == []
    with pytest.raises(KeyError):
        s.get_all("c")


@pytest.mark.parametrize("buckets", [1, 5])
def test_store_against_a_plain_table(spark, tmp_path, buckets):
    """Changes in any order, with compactions between them, nulls and rows that share a key."""
    rng = random.Random(buckets)
    s = CollectionStore(spark, str(tmp_path / "s"), buckets=buckets, folders=6)
    mk = lambda rows: spark.createDataFrame(rows, "id long, v string")
    held = [(i, f"a{i}") for i in range(40)] + [(None, "n"), (3, "twice")]
    s.create("c", mk(held))
    for step in range(8):
        ids = rng.sample(range(60), 6)
        kind = ("upsert", "delete", "add", "upsert", "compact")[step % 5]
        rows = [(i, f"{kind}{step}-{i}") for i in ids] + ([(ids[0], "again"), (None, "x")] if kind == "upsert" else [])
        if kind in ("upsert", "delete"):
            held = [r for r in held if r[0] is None or r[0] not in ids]
        if kind in ("upsert", "add"):
            held += rows
            getattr(s, kind)("c", mk(rows))
        elif kind == "delete":
            s.delete("c", spark.createDataFrame([(i,) for i in [*ids, None]], "id int"))
        else:
            s.compact("c", share=rng.choice([0.0, 0.3]))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, s.get_all("c").collect()), key=key) == sorted(held, key=key), kind
        assert sorted(map(tuple, s.get("c", mk([(i, "") for i in ids])).collect())) == sorted(r for r in held if r[0] in ids)
    assert s.info("c").first()["count"] == len(held) and len(s._manifest("c")["entries"]) <= 7
    s.delete("c", s.get_all("c").select("id"))
    assert [r.id for r in s.get_all("c").collect()] == [None] * sum(i is None for i, _ in held)


def test_a_change_writes_in_proportion_to_itself(spark, tmp_path):
    s = CollectionStore(spark, str(tmp_path / "s"), buckets=4)
    df = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    s.create("c", df)
    before, files = s.bytes("c"), {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    s.upsert("c", df.where("id % 100 = 7").withColumn("v", F.reverse("v")))
    assert s.bytes("c") - before < 0.03 * before
    assert all(f.stat().st_mtime_ns == at for f, at in files.items())  # what was there is as it was
    assert s.get_all("c").count() == 40_000 and s.get_all("c").where("v = reverse(sha2(cast(id as string), 256))").count() == 400
    assert s.compact("c") == [] and s.compact("c", share=0.01) == [0, 1, 2, 3]
    assert s.bytes("c") < 1.03 * before and s.get_all("c").where("v = reverse(sha2(cast(id as string), 256))").count() == 400


def test_of_two_writers_one_loses_cleanly(spark, tmp_path):
    first, second = (CollectionStore(spark, str(tmp_path / "s")) for _ in range(2))
    mk = lambda rows: spark.createDataFrame(rows, "id long, v string")
    first.create("c", mk([(1, "a"), (2, "b")]))
    base = second._current("c")
    first.upsert("c", mk([(1, "first")]))
    names = set(first._names(f"{first.root}/c"))
    for late in (base, base | {"version": 0}):
        with pytest.raises(WriteConflict):
            second._commit("c", late, mk([(1, "second")]), mk([(1, "")]))
        assert {r.id: r.v for r in second.get_all("c").collect()} == {1: "first", 2: "b"} and set(first._names(f"{first.root}/c")) - names <= {"_claim-00000000000000000001"}
    second.upsert("c", mk([(2, "second")]))  # from what is there now
    assert {r.id: r.v for r in first.get_all("c").collect()} == {1: "first", 2: "second"}
    # the claim of a writer that died
    first._fs.create(first._path(f"{first.root}/c/_claim-{first._current('c')['version'] + 1:020d}"), False).close()
    with pytest.raises(WriteConflict):
        first.delete("c", mk([(1, "")]))
    time.sleep(1.1)
    CollectionStore(spark, first.root, patience=1.0).delete("c", mk([(1, "")]))
    assert [r.id for r in first.get_all("c").collect()] == [2]


def test_json_round_trip(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert sorted(map(tuple, import_json(export_json(d), "i int, t string").collect())) == [(1, "a"), (2, None)]


def test_config():
    assert config.from_mapping({"k": "7", "other": 1}).k == 7
    with pytest.raises(ValueError):
        config.from_mapping({"chunk_overlap": 900})


def test_streamed_index_equals_batch(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    src = str(tmp_path / "in")
    docs.limit(60).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(120)
    got, want = streams.load_ingested(spark, str(tmp_path / "ix")), index.build(spark.read.parquet(src), mode=None)
    assert got.postings.select("term", "doc_id", "tf").exceptAll(want.postings.select("term", "doc_id", "tf")).count() == 0
    assert got.numbers.first().n == want.numbers.first().n == 60
    # more files: some documents again, changed
    docs.limit(20).withColumn("text", F.concat(F.lit("changed anew "), "text")).coalesce(1).write.mode("append").parquet(src)
    docs.limit(75).where("doc_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    streams.ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(120)
    got = streams.load_ingested(spark, str(tmp_path / "ix"))
    sent = spark.read.parquet(src).count()
    assert sent > got.numbers.first().n == docs.limit(60).unionByName(docs.limit(75).where("doc_id % 2 = 0")).select("doc_id").distinct().count()
    assert got.postings.where("term = 'anew'").count() == docs.limit(20).where("doc_id % 2 = 1").count()


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    src = str(tmp_path / "ev")
    e.repartition(1).sortWithinPartitions("ts").write.parquet(src)
    stream = streams.windowed_metrics(spark.readStream.schema(e.schema).parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == streams.windowed_metrics(spark.read.parquet(src)).count()


def _folder(tmp_path, named: dict[str, bytes]) -> str:
    for name, raw in named.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    return str(tmp_path)


def test_data_source_reads_folders(spark, tmp_path):
    named = {"a.TXT": b"eins", "sub/b.md": "größe".encode(), "sub/c": b"x", "empty.txt": b"", "sub/.hidden": b"no", "_skipped/d.txt": b"no", "e.html": b"<p>Hi</p>", "big.txt": b"y" * 100}
    root = _folder(tmp_path, named)
    rows = {r.path: r for r in datasource.read(spark, root, max_bytes=50).collect()}
    assert set(rows) == {f"{root}/{n}" for n in ("a.TXT", "sub/b.md", "sub/c", "empty.txt", "e.html", "big.txt")}
    assert {(r.name, r.extension, r.size, None if r.content is None else bytes(r.content)) for r in rows.values()} == {("a.TXT", ".txt", 4, b"eins"), ("b.md", ".md", 7, "größe".encode()), ("c", "", 1, b"x"), ("empty.txt", ".txt", 0, b""), ("e.html", ".html", 9, b"<p>Hi</p>"), ("big.txt", ".txt", 100, None)}
    docs, rejects = files.load_files(datasource.read(spark, root, max_bytes=50).select("path", "modified", "size", "content"), most=50)
    assert {(r.name, r.text) for r in docs.collect()} == {("a.TXT", "eins"), ("b.md", "größe"), ("c", "x"), ("e.html", "Hi")}
    assert {(r.path, r.reject) for r in rejects.collect()} == {(f"{root}/empty.txt", "empty"), (f"{root}/big.txt", "too large")}
    assert [r.path for r in datasource.read(spark, f"{root}/a.TXT").collect()] == [f"{root}/a.TXT"]
    assert {r.name for r in datasource.read(spark, root, [("extension", "in", [".md", ".html"])]).collect()} == {"b.md", "e.html"}
    assert datasource.read(spark, f"file://{root}/sub").count() == 2


def test_data_source_plans_by_bytes_and_conditions(spark, tmp_path):
    root = _folder(tmp_path, {f"{i % 3}/f{i:02d}{'.txt' if i % 2 else '.md'}": b"z" * (i * 1000) for i in range(40)})
    found = datasource.read(spark, root, partition_bytes=300_000)
    whole = found.rdd.getNumPartitions()
    assert whole > 2 and found.count() == 40
    plain = spark.createDataFrame(found.drop("content").collect(), found.drop("content").schema)  # filtered by Spark alone
    for where, sql, n in (
        ([("extension", "=", ".md")], "extension = '.md'", 20), ([("size", "<", 10000)], "size < 10000", 10), ([("size", ">=", 5000), ("size", "<=", 7000)], "size between 5000 and 7000", 3),
        ([("name", "in", ["f01.txt", "f04.md", "none"])], "name in ('f01.txt', 'f04.md', 'none')", 2), ([("name", "startswith", "f3")], "startswith(name, 'f3')", 10), ([("path", "contains", "f07")], "path like '%f07%'", 1),
        ([("extension", "!=", ".md"), ("size", ">", 30000)], "extension <> '.md' and size > 30000", 5), ([("name", "not in", ["f01.txt"]), ("path", "endswith", "1.txt")], "name <> 'f01.txt' and endswith(path, '1.txt')", 3),
    ):
        some = datasource.read(spark, root, where, partition_bytes=300_000)
        assert some.rdd.getNumPartitions() < whole, where
        assert sorted(r.path for r in some.collect()) == sorted(r.path for r in plain.where(sql).collect()) and some.count() == n, where
        assert some.where("size < 0").count() == 0 and some.count() == n  # a later filter changes no other use
    assert datasource.read(spark, root, [("extension", "=", ".none")]).count() == 0
    assert datasource.read(spark, root, [("modified", "<", datetime(2000, 1, 1))]).count() == 0 and datasource.read(spark, root, [("modified", ">", "2000-01-01")]).count() == 40
    for bad in (("content", "=", "x"), ("size", "like", 1), ("size", "=", "1"), ("size", "contains", 1), ("name", "=", None)):
        with pytest.raises(Exception, match="no such condition|compared"):
            datasource.read(spark, root, [bad]).count()
    with pytest.raises(Exception, match="no/such"):
        datasource.read(spark, "/no/such/folder").count()


def test_data_source_writes_files(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", bytearray(b"eins"), 1), ("s/t/b.bin", bytearray(b"\x00\xff"), 2), ("null.txt", None, 3), ("a.txt", bytearray(b"eins"), 4)], "path string, content binary, size int")
    datasource.write(rows, root)
    datasource.write(rows.where("size = 2").withColumn("content", F.lit("neu").cast("binary")), root)  # replaced by name
    assert {(r.path[len(root) + 1 :], bytes(r.content)) for r in datasource.read(spark, root).collect()} == {("a.txt", b"eins"), ("s/t/b.bin", b"neu"), ("null.txt", b"")}
    assert not [p for p in Path(root).rglob(".writing-*")]
    for bad in (None, "", "/x.txt", "../x.txt", "a/../../x.txt", "x/"):
        with pytest.raises(Exception, match="not a path inside"):
            datasource.write(spark.createDataFrame([(bad, bytearray(b"x"))], "path string, content binary"), root)
    empty = str(tmp_path / "empty")
    Path(empty).mkdir()
    datasource.write(rows.where("size > 9"), empty)
    assert datasource.read(spark, empty).count() == 0
    with pytest.raises(Exception, match="append"):
        rows.select("path", "content").write.format(datasource.NAME).mode("overwrite").save(root)
