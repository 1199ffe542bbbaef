"""Inverted files of vectors, and postings in blocks, against scans and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, fuzzy, index, ivf, keyword, prefixes, segments, vectors
from docloom.plans import retrieval

VOCAB = [f"w{i}" for i in range(60)]


def texts(n, seed, longest=60):
    """Prose of few words, the first ones very frequent, with one-letter words, other separators, nulls, blanks and a long text."""
    rng = random.Random(seed)
    out = [" ".join(rng.choice(VOCAB[: rng.choice((3, 10, 60))] + ["a", "B"]) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randrange(longest))) for _ in range(n)]
    return [*out, None, "", " \n ", "...", " ".join(["w1 w2"] * 3000), out[0], out[0]]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(enumerate(texts(300, 1)))
    random.Random(9).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("term", "block", "n", "tf", "docs", "score")})


@pytest.fixture(scope="module")
def built(spark, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("blocks")
    tech = keyword.technical(F.col("text"), ("w40",))
    return [blocks.build(corpus[1], str(at / str(size)), mode=None, technical=tech, block=size) for size in (7, 128)]


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def test_blocks_hold_the_words_of_their_documents(corpus, built):
    want = {(w, d): [i for i, x in enumerate(tokens(t)) if x == w] for d, t in corpus[0] for w in set(tokens(t))}
    for b in built:
        ids = {r.block: r for r in b.documents.collect()}
        assert sorted(x for r in ids.values() for x in r.doc_ids) == sorted(d for d, _ in corpus[0])
        got, bounded = {}, True
        for r in b.postings.collect():
            places = blocks.positions(np.array(r.docs), np.array(r.tfs), np.array(r.gaps))
            for at, tf in zip(r.docs, r.tfs, strict=True):
                got[r.term, ids[r.block].doc_ids[at]] = (places[places >> 32 == at] & 0xFFFFFFFF).tolist()
                assert any(i.tf >= tf and i.dl <= ids[r.block].dls[at] for i in r.impacts)
            pairs = [(tf, ids[r.block].dls[at]) for at, tf in zip(r.docs, r.tfs, strict=True)]
            assert {(i.tf, i.dl) for i in r.impacts} == {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
            assert r.n == len(r.docs) and r.counted == (len(r.term) >= 2)
        assert got == want and bounded
    plain = index.build(corpus[1], mode=None)
    for b in built:
        rows = b.index()
        assert {tuple(r) for r in rows.postings.select("term", "doc_id", "tf").collect()} == {tuple(r) for r in plain.postings.select("term", "doc_id", "tf").collect()}
        assert {tuple(r) for r in rows.frequencies().collect()} == {tuple(r) for r in plain.frequencies().collect()}
        assert {(r.doc_id, r.dl) for r in rows.lengths.collect()} == {(r.doc_id, r.dl) for r in plain.lengths.collect()}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_pruned_search_equals_the_full_one(spark, built, k):
    """Also for terms in more than half of the documents, whose weight is negative, and for queries without a hit."""
    queries = {1: "w0 w45", 2: "w50 w51 w52", 3: "w1", 4: "w0 w1 w2 w3 w59", 5: "nowhere", 6: "w40 w41", 7: "a w12"}
    terms = keyword.query_table(spark, queries, mode=None)
    full = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in keyword.search(built[0].index(), terms, "bm25", k).withColumn("score", F.round("score", 9)).collect()}
    for b in built:
        got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in blocks.top_k(b, terms, k).collect()}
        assert got == full
    counts = {r.query_id: r for r in blocks.decoded(built[0], terms, k).collect()}
    assert all(r.decoded <= r.rows for r in counts.values())
    if k == 1:
        assert sum(r.decoded for r in counts.values()) < 0.6 * sum(r.rows for r in counts.values())


def occurrences(words, phrase):
    n, i = 0, 0
    while i + len(phrase) <= len(words):
        if words[i : i + len(phrase)] == phrase:
            n, i = n + 1, i + len(phrase)
        else:
            i += 1
    return n


def test_phrases_against_plain_python(spark, corpus, built):
    asked = {1: ["w0 w1", "w2"], 2: ["a b a"], 3: ["w1 w2 w1 w2"], 4: ["W0, w0"], 5: ["w1 nowhere"], 6: ["..."]}
    want = {}
    for d, t in corpus[0]:
        for q, phrases in asked.items():
            raw = sum(occurrences(tokens(t), tokens(p)) / len(tokens(p)) for p in phrases if tokens(p))
            if raw:
                want[q, d] = round(min(1.0, raw / (len(t.split()) / 100)), 9)
    for b in built:
        assert {(r.query_id, r.doc_id): round(r.score, 9) for r in blocks.phrases(b, spark, asked).collect()} == want
    assert {q for q, _ in want} == {1, 2, 3, 4}


def test_phrases_equal_the_scan_where_words_are_set_apart_by_blanks(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(VOCAB[:9]) for _ in range(40))) for i in range(100)], "doc_id long, text string")
    b = blocks.build(docs, str(tmp_path / "b"), mode=None, block=16)
    for p in ("w1 w2", "w3 w4 w5", "w8"):
        got = {r.doc_id: round(r.score, 9) for r in blocks.phrases(b, spark, {1: [p]}).collect()}
        assert got == {r.doc_id: round(r.score, 9) for r in keyword.phrase(docs, f'"{p}"').collect()}


def test_proximity_against_plain_python(spark, corpus, built):
    asked, window = {1: "w0 w1", 2: "w5 w6 w7", 3: "w3", 4: "w1 w1", 5: "w2 nowhere"}, 9
    want = {}
    for d, t in corpus[0]:
        words = tokens(t)
        for q, text in asked.items():
            need = set(tokens(text))
            spans = [e - s + 1 for s in range(len(words)) if words[s] in need for e in range(s, min(len(words), s + window)) if need <= set(words[s : e + 1])]
            if spans:
                want[q, d] = (min(spans), round(len(need) / min(spans), 9))
    for b in built:
        assert {(r.query_id, r.doc_id): (r.span, round(r.score, 9)) for r in blocks.near(b, spark, asked, window).collect()} == want


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    b = blocks.build(docs, str(tmp_path / "b"), mode=None)
    terms = keyword.query_table(spark, {1: "w1"}, mode=None)
    assert blocks.top_k(b, terms).count() == blocks.phrases(b, spark, {1: ["w1 w2"]}).count() == blocks.near(b, spark, {1: "w1"}).count() == 0


def test_new_rows_are_found(spark, sf, tmp_path):
    """An index is that of the files as they are when a query runs."""
    row = "doc_id long, text string"
    spark.createDataFrame([(1, "one eau two")], row).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in retrieval.tfidf_topk(spark, str(tmp_path)).collect()] == [1]
    spark.createDataFrame([(2, "eau eau three")], row).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in retrieval.tfidf_topk(spark, str(tmp_path)).collect()} == {1, 2}


# segments


def test_segments_equal_a_batch_build(spark, tmp_path, fan=3):
    """Documents sent again changed, repeated in a batch, without id, deleted and sent anew, with and without merges between."""
    rng = random.Random(fan)
    ix = segments.SegmentedIndex(spark, str(tmp_path / "ix"), fan=fan, version="v")
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, v int")
    held, nameless, number = {}, [], 0
    for step in range(6):
        if step == 3:
            gone = rng.sample(sorted(held), 12)
            assert ix.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"), number)
            held = {d: t for d, t in held.items() if d not in gone}
        else:
            rows = [(rng.randrange(90), t, i) for i, t in enumerate(texts(25, 100 * fan + step, 30)[:30])]
            if step == 1:
                rows.append((None, "w0 w1 nameless", 0))
                nameless.append("w0 w1 nameless")
            assert ix.add(mk(rows), number)
            held |= {d: t for d, t, _ in rows if d is not None}
            assert not ix.add(mk([(1, "run again", 1)]), number)
        number += 1
    state = ix.state()
    assert len(state["segments"]) < 5
    assert len([n for n in ix.names() if n.startswith("seg-")]) <= 2 * 6
    docs = spark.createDataFrame([*held.items(), *((None, t) for t in nameless)], "doc_id long, text string")
    want = blocks.build(docs, str(tmp_path / "batch"), mode=None)
    got = ix.blocks()
    key = lambda b: Counter(tuple(r) for r in b.index().postings.collect())
    assert key(got) == key(want)
    assert got.numbers.first() == want.numbers.first()
    assert Counter(map(tuple, got.lengths().collect())) == Counter(map(tuple, want.lengths().collect()))
    assert set(map(tuple, got.index().frequencies().collect())) == set(map(tuple, want.index().frequencies().collect()))
    named = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    terms = keyword.query_table(spark, {1: "w0 w45", 2: "w50 w51 w3"}, mode=None)
    top = lambda b: [(r.query_id, r.doc_id, round(r.score, 8)) for r in blocks.top_k(b, terms, 4).orderBy("query_id", "rank").collect()]
    assert top(got) == top(want)
    found = lambda b: Counter((r.doc_id, round(r.score, 9)) for r in blocks.phrases(b, spark, {1: ["w0 w1", "w2"]}).collect())
    assert found(got) == found(want) and named.count() == len(held)


def test_a_segment_is_read_as_its_build_left_it(spark, tmp_path):
    """A build writes its postings beside its documents' rows, a merge in a table of their own; readers once looked for the latter only."""
    ix = segments.SegmentedIndex(spark, str(tmp_path / "ix"), fan=2)
    mk = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda: sorted((r.term, r.doc_id, r.tf) for r in ix.index().postings.collect())
    assert ix.add(mk((1, "aa bb aa"), (2, None)), 0) and words() == [("aa", 1, 2), ("bb", 1, 1)]
    assert ix.add(mk((1, "cc"), (3, "bb")), 1) and words() == [("bb", 3, 1), ("cc", 1, 1)]
    assert len(ix.state()["segments"]) == 1
    for n in range(2, 5):
        assert ix.add(mk((n + 2, "dd")), n)
    assert words() == [("bb", 3, 1), ("cc", 1, 1), *(("dd", n, 1) for n in (4, 5, 6))]


# fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.65, 0.75, 0.8, 0.9, 1.0])
def test_alike_words_against_all_pairs(spark, least):
    """Words of one to forty letters, each with neighbours some edits away, and letters beyond ASCII."""
    rng = random.Random(int(least * 100))
    words = {"".join(rng.choice("abcdeüß漢") for _ in range(rng.choice((1, 2, 3, 5, 8, 11, 14, 19, 27, 40)))) for _ in range(60)}
    for w in list(words):
        for n in (1, 2, 3, 5):
            x = list(w)
            for _ in range(n):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
            words.add("".join(x))
    words = sorted(words - {""})
    asked = rng.sample(words, 40) + ["zzzz"]
    got = fuzzy.alike(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(q,) for q in asked], "q string"), least)
    want = {(w, q) for w in words for q in asked if 1 - distance(w, q) / max(len(w), len(q)) >= least - 1e-12}
    assert {(r.word, r.q) for r in got.collect()} == want
    if least >= 0.5:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filed_words_give_the_same(spark, built, tmp_path):
    ix = built[0].index()
    terms = keyword.query_table(spark, {1: "w10 w5x", 2: "w41w nothing"}, mode=None)
    fuzzy.variants(ix.frequencies().select(F.col("term").alias("word")), 0.6).sort("key").write.parquet(str(tmp_path / "filed"))
    got = keyword.fuzzy(ix, terms, 0.6, spark.read.parquet(str(tmp_path / "filed"))).collect()
    assert got and sorted(got) == sorted(keyword.fuzzy(ix, terms, 0.6).collect())


def test_prefix_table(spark, tmp_path):
    rng = random.Random(6)
    terms = {"".join(rng.choice("abü") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(300)}
    rows = lambda t: spark.createDataFrame(list(t.items()), "term string, df long")

    def want(prefix, held, most):
        return sorted(((w, n) for w, n in held.items() if w.startswith(prefix)), key=lambda x: (-x[1], x[0]))[:most]

    table = prefixes.store(prefixes.ranked(rows(terms), 4, 3), str(tmp_path / "p"))
    asked = ("a", "ab", "üa", "aab", "bbü", "zz")
    assert {p: [tuple(r) for r in prefixes.complete(table, p, 4).collect()] for p in asked} == {p: want(p, terms, 4) for p in asked}
    assert [tuple(r) for r in prefixes.complete(table, "AB", 2).collect()] == want("ab", terms, 2)
    later = {w: n for i, (w, n) in enumerate(terms.items()) if i % 50} | {"abnew": 99, "q": 1}
    changed = [w for w in terms if w not in later] + ["abnew", "q"]
    new = prefixes.updated(table, rows(later), spark.createDataFrame([(w,) for w in changed], "term string"), 4, 3)
    assert {tuple(r) for r in new.collect()} == {tuple(r) for r in prefixes.ranked(rows(later), 4, 3).collect()}


# vectors


def vector_rows(n, dim=12, groups=15, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dim))
    return [(i, v, i % 4) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("metric", ivf.METRICS)
def test_inverted_file(spark, tmp_path, metric):
    rows = [*vector_rows(900), (1000, None, 1), (1001, [math.nan] * 12, 1), (1002, [None] * 12, 1), (None, [1.0] * 12, 1), (1003, [0.0] * 12, 1), (1004, [], 1)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    queries = store.where("vec_id % 20 = 0 AND vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    ix = ivf.build(store, str(tmp_path / "ivf"), metric, cells=30)
    assert ix.table.count() == 901 and Counter(r["count"] for r in ix.table.groupBy("vec_id").count().collect()) == {1: 901}
    good = store.where("vec_id < 900 OR vec_id = 1003")
    scan = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in vectors.knn_matrix(good, queries, 10, metric).collect()}
    exact = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in ivf.search(ix, queries, 10, exact=True).collect()}
    assert exact == scan
    tuned, found = ivf.tune(ix, queries, target=0.95)
    hits = {(q, v) for (q, _), (v, _) in scan.items()} & {(r.query_id, r.vec_id) for r in ivf.search(tuned, queries, 10).collect()}
    assert len(hits) >= 0.9 * len(scan) and found >= 0.95 and ivf.recall(tuned, queries) == pytest.approx(len(hits) / len(scan))
    assert tuned.probes < 15 and ivf.load(spark, ix.path).probes == tuned.probes and np.allclose(ivf.load(spark, ix.path).centroids, ix.centroids)
    opened, every = ivf.files_read(tuned, queries.limit(1))
    assert opened <= every * tuned.probes / 10


def test_inverted_file_of_odd_stores(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    none = ivf.build(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert ivf.search(none, q).count() == 0 and ivf.search(none, q.limit(0)).count() == 0
    same = ivf.build(spark.createDataFrame([(i, [2.0, 0.0]) for i in range(40)], schema), str(tmp_path / "same"))
    assert [r.vec_id for r in ivf.search(same, q, 3, exact=True).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="another length"):
        ivf.build(spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0])], schema), str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="manhattan"):
        ivf.build(spark.createDataFrame([], schema), str(tmp_path / "no"), "manhattan")


def test_cells_send_little_to_the_driver(spark, tmp_path, monkeypatch):
    """Each round of the fit used to send the distances of all pairs of cells (a task each), and each block of queries listed the folders of all cells anew."""
    sc, seen = spark.sparkContext, spark.sparkContext.statusTracker()
    tasks = lambda group: sum(seen.getStageInfo(i).numTasks for j in seen.getJobIdsForGroup(group) for i in seen.getJobInfo(j).stageIds)
    store = spark.createDataFrame(vector_rows(900), "vec_id long, embedding array<double>, label int").coalesce(1)
    queries = store.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    try:
        sc.setJobGroup("cells-build", "")
        ix = ivf.build(store, str(tmp_path / "ivf"), cells=200)
        sc.setJobGroup("cells-one", "")
        one = ivf.search(ix, queries, 10).collect()
        for module in (ivf, vectors):
            monkeypatch.setattr(module, "BLOCK", 10)
        sc.setJobGroup("cells-blocks", "")
        many = ivf.search(ix, queries, 10)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(ix.centroids) == 200 and ix.table.inputFiles() and tasks("cells-build") < 5 * 200 and tasks("cells-blocks") < 200
    assert sorted(one) == sorted(many.collect()) and len(one) == 450


@pytest.mark.parametrize("metric", ivf.METRICS)
def test_all_cells_score_as_a_scan_does(spark, tmp_path, metric):
    """To the last bit, so that copies in cells of other sizes tie and stand by id; also queries in single precision and those that find nothing."""
    rows = [(i, v) for i, (_, v, _) in enumerate(vector_rows(120) * 4)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = store.where("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 12)], "query_id long, vector array<float>")
    ix = ivf.build(store, str(tmp_path / "ivf"), metric, cells=20)
    want = vectors.knn(store, queries, 10, metric).select("query_id", "rank", "vec_id", "score")
    got = ivf.search(ix, queries.unionByName(odd), 10, exact=True).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 600


def test_query_recall(spark, sf):
    """ids divisible by 20 against all rows, as registered."""
    got = retrieval.ivf_search(spark, sf).join(retrieval.ivf_exact(spark, sf).select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    assert got >= 0.9 * retrieval.ivf_exact(spark, sf).count()


def test_an_index_is_built_without_a_shuffle_in_sorted_runs(spark, tmp_path):
    """Postings of all blocks used to be sorted over ranges, which shuffled and spilled them."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(30))) for i in range(400)], "doc_id long, text string").repartition(8)
    docs.write.parquet(f"{tmp_path}/docs")
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    b = blocks.build(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/ix", mode=None, block=16)
    made = [store.planGraph(store.executionsList().apply(i).executionId()).allNodes() for i in range(seen, store.executionsList().size())]
    assert [n for nodes in made for n in (nodes.apply(j).desc() for j in range(nodes.size())) if "rangepartitioning(term" in n] == []
    for r in b.postings.groupBy(F.input_file_name()).agg(F.collect_list("term").alias("terms")).collect():
        assert r.terms == sorted(r.terms)
    assert b.postings.groupBy().agg(F.sum("n")).first()[0] == docs.select("doc_id", F.explode(F.split("text", " "))).distinct().count()
