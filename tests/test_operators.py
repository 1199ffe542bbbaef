import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import analyze as an
from docloom.operators import classify as cl
from docloom.operators import context as cx
from docloom.operators import enrich as en
from docloom.operators import fusion, index, keyword, literals, router, split, vectors
from docloom.operators import monitor as mo


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


DOCS = [("d1", "pumpe defekt pumpe"), ("d2", "motor läuft"), ("d3", "ventil defekt"), ("d4", "lager alt")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


@pytest.fixture(scope="module")
def small(spark, docs):
    return index.build(docs, mode=None, technical=keyword.technical(F.col("text")))


@pytest.mark.parametrize("word,stem", [("wartung", "wart"), ("fehler", "fehl"), ("sicherheit", "sicher"), ("pumpe", "pump"), ("motor", "motor"), ("es", "es"), ("ebenen", "eben"), ("ungung", "ung")])
def test_stem(spark, word, stem):
    assert one(spark, tx.stem_word(F.lit(word))) == stem


def test_literals():
    assert tx.literals(r"\bservice\s*(?:modus|mode)\b") == ["service"] and tx.literals(r"\b(?:anhang|anlage)\b") == ["anhang", "anlage"]
    assert tx.literals("abcd?e") == ["abc"] and tx.literals("abc*") == [] and tx.literals(r"\d+") == [] and tx.literals("⚠️|⚡") == []


def test_preprocess(spark):
    assert one(spark, tx.normalize_numbers(F.lit("2,5 kg"))) == "2.5 kilogramm"
    assert one(spark, tx.expand_acronyms(F.lit("die sps geht"))) == "die SPS Speicherprogrammierbare Steuerung geht"
    assert one(spark, tx.tokens(F.lit("füllstand größe x"))) == ["füllstand", "größe"]
    assert one(spark, tx.multilingual(F.lit("motor an"))) == "motor motor engine an"
    assert one(spark, tx.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, 3)) == ["a b", "b c", "a b c"]
    assert one(spark, tx.query_terms(F.lit("motor an motor"), synonyms=False)) == ["motor", "an", "motor an", "an motor"]


def test_bm25(spark, small):
    found = keyword.bm25(small, keyword.query_table(spark, {1: "pumpe defekt"}, mode=None)).collect()
    assert [r.doc_id for r in found] == ["d1"]  # a term in half of the documents weighs nothing
    assert found[0].raw == pytest.approx(1.093288 * 1.3, abs=1e-5) and found[0].score == pytest.approx(0.142127, abs=1e-5)


def test_tfidf(spark, small):
    found = {r.doc_id: r.score for r in keyword.tfidf(small, keyword.query_table(spark, {1: "pumpe defekt"}, mode=None)).collect()}
    assert found["d1"] == pytest.approx(0.372677, abs=1e-5) and found["d3"] == pytest.approx(0.110055, abs=1e-5)


def test_fuzzy(spark, docs):
    ix = index.build(spark.createDataFrame([("a", "steuerung"), ("b", "xyz")], "doc_id string, text string"), mode=None)
    found = keyword.fuzzy(ix, keyword.query_table(spark, {1: "steurung fehlt"}, mode=None)).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in found] == [("a", 0.444444)]


def test_boolean(spark):
    d = spark.createDataFrame([("x", "alpha beta"), ("y", "alpha gamma")], "doc_id string, text string")
    score = lambda q: {r.doc_id: round(r.score, 6) for r in keyword.boolean(d, q).collect()}
    assert score("alpha AND beta") == {"x": 0.6}
    assert score("alpha NOT beta") == {}
    assert score("beta OR gamma") == {"x": 0.35, "y": 0.35}
    assert score("alpha beta") == {"x": 0.6}


def test_phrase(spark):
    d = spark.createDataFrame([("x", "oil change " + "w " * 98)], "doc_id string, text string")
    assert keyword.phrase(d, '"oil change"').first().score == pytest.approx(0.5)
    assert keyword.phrase(d, "  ").count() == 0


def test_contexts_and_highlight(spark):
    assert one(spark, tx.contexts(F.lit("aaa Öl bbb öl"), "öl", 4)) == ["aaa Öl bbb", "bbb öl"]
    assert one(spark, tx.contexts(F.lit("none"), "öl", 4)) == []
    assert one(spark, tx.highlight(F.lit("Die Pumpe"), ["pumpe"])) == "Die <mark>pumpe</mark>"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8))
    want = {"cosine": 0.6, "dot": 0.6, "euclidean": 0.527864, "manhattan": 0.454545, "angular": 1 - math.acos(0.6) / math.pi}
    for name, fn in vx.METRICS.items():
        assert one(spark, fn(a, b)) == pytest.approx(want[name], abs=1e-5)
    assert one(spark, vx.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vx.from_distance(F.lit(0.5))) == 0.75 and one(spark, vx.from_distance(F.lit(2.5))) == 0
    e = one(spark, vx.hash_embedding(F.lit("motor"), 64))
    assert e[:3] == [-0.984313725490196, 0.19215686274509805, -0.5607843137254902] and e[:32] == e[32:]
    assert one(spark, vx.hash_embedding(F.lit("   "), 8)) == [0.0] * 8


def test_multi_vector(spark):
    p = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.1)], "group_id int, place int, score double")
    for how, want in (("mean", 0.5), ("max", 0.9), ("concat", 0.526622)):
        assert vectors.multi_vector(p, how).first().score == pytest.approx(want, abs=1e-5)


def sides(spark, v, k):
    mk = lambda rows: spark.createDataFrame([(1, d, s) for d, s in rows], "query_id int, doc_id string, score double")
    return mk(v), mk(k)


def test_fusion(spark):
    v, k = sides(spark, [("a", 3.0), ("b", 2.0), ("c", 1.0)], [("b", 3.0), ("d", 2.0), ("a", 1.0)])
    got = {r.doc_id: r.score for r in fusion.rrf(v, k).collect()}
    assert [round(got[x], 6) for x in "abcd"] == [0.016237, 0.016208, 0.011111, 0.004839]
    v, k = sides(spark, [("a", 0.9), ("b", 0.5)], [("b", 0.4), ("c", 0.2)])
    got = {r.doc_id: round(r.score, 6) for r in fusion.weighted(v, k).collect()}
    assert got == {"a": 0.7, "b": 0.3, "c": 0.0}
    assert {r.doc_id: r.score for r in fusion.fuse(v, k.where("false")).collect()} == {"a": 0.9, "b": 0.5}
    assert fusion.fuse(v.where("false"), k.where("false")).count() == 0
    assert fusion.fuse(v, k.where("false"), fallback=False, require_both=True).count() == 0


def test_equal_weights_are_symmetric(spark):
    v, k = sides(spark, [("a", 3.0), ("b", 2.0)], [("b", 3.0), ("d", 2.0)])
    s = lambda x, y: {r.doc_id: round(r.score, 12) for r in fusion.rrf(x, y, (0.5, 0.5)).collect()}
    assert s(v, k) == s(k, v)


def test_mmr_and_duplicates(spark):
    rows = [(1, "x", "alpha beta gamma", 0.9), (1, "y", "alpha beta gamma delta", 0.85), (1, "z", "epsilon zeta", 0.5)]
    d = spark.createDataFrame(rows, "query_id int, doc_id string, content string, score double")
    got = fusion.mmr(d, 2).orderBy("place").collect()
    assert [(r.doc_id, round(r.mmr, 6)) for r in got] == [("x", 0.9), ("z", 0.25)]
    assert sorted(r.doc_id for r in fusion.near_duplicates(d, 0.7).collect()) == ["x", "z"]


def test_rerank(spark):
    score = lambda n: one(spark, fusion.rerank(F.lit(0.5), F.lit("alpha omega"), F.lit("alpha " + "x" * (n - 6))))
    assert score(1500) == pytest.approx(0.65) and score(60) == pytest.approx(0.70)


def test_adaptive_weights(spark):
    q = spark.createDataFrame([(1, "motor sensor an")], "query_id int, text string")
    r = fusion.adaptive_weights(q).first()
    assert (round(r.vector_weight, 6), round(r.keyword_weight, 6)) == (0.4, 0.6)


def test_jaccard(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, tx.jaccard(arr(), arr())) == 1 and one(spark, tx.jaccard(arr(), arr("a"))) == 0
    assert one(spark, tx.jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)


@pytest.mark.parametrize("text,want", [("1. auf 2. ab 3. zu ", True), ("1. a 2. b 4. c ", False), ("2. a 1. b ", False), ("1. a ", False), ("99999999999999999999. a 2. b ", False)])
def test_steps(spark, text, want):
    assert one(spark, an.sequential_steps(F.lit(text))) is want


def test_analysis(spark):
    rows = [(1, "1. Gehe zu. 2. Drücke. 3. Warte. 4. Fertig."), (2, "Installation der Anlage"), (3, "Spannung: 24V und Leistung: 150W"), (4, "Bei Problemen prüfen: problem"), (5, "  "), (6, None)]
    got = {r.i: r.analysis for r in an.analyze(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert (got[1].content_type, got[1].has_steps, got[1].step_count, got[1].confidence) == ("step_by_step_guide", True, 4, 1.0)
    assert got[2].content_type == "installation_guide" and got[3].content_type == "technical_specifications" and got[4].content_type == "troubleshooting"
    assert len(got[3].technical_terms) == 2
    assert (got[5].content_type, got[5].confidence) == ("general", 0.0) and got[6].content_type == "general"


def test_classification(spark):
    rows = [(1, "Gefahr: unbedingt beachten"), (2, "ganz gewöhnlich"), (3, None)]
    got = {r.i: r.classification for r in cl.classify(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got[1].primary == "safety" and "compliance" in got[1].secondary  # "unbedingt" holds "din"
    assert (got[2].primary, got[2].total, got[2].confidences) == ("documentation", 0.0, {})
    assert got[3].primary == "documentation"


def test_enrichment(spark):
    assert one(spark, en.search_boost(F.lit("excellent"), F.lit("critical"), F.array(F.lit("has_procedures"), F.lit("has_specifications")))) == 2.0
    assert one(spark, en.search_boost(F.lit("poor"), F.lit("none"), F.array().cast("array<string>"))) == 0.7
    assert one(spark, en.prerequisites(F.lit("anyone"), F.lit("operation"))) == "Keine"
    rows = [("s", 0, "a", "d", ["x"]), ("s", 9, "a", "d", ["y"]), ("s", 1, "a", "e", ["z"])]
    r = en.related_chunks(spark.createDataFrame(rows, "source string, chunk_index int, category string, domain string, keywords array<string>"))
    assert {x.chunk_index: x.related for x in r.collect()} == {0: [9], 9: [0]}
    e = en.enrich(spark.createDataFrame([("Lebensgefahr! 5 kV",), (" ",)], "text string"), rules=lx.INDUSTRIAL_RULES)
    assert sorted(r.enrichment.safety for r in e.collect()) == ["critical", "none"]


def test_splitters(spark):
    text = "\n\n# Titel\n" + "Satz eins ist da. " * 40 + "\n\n## Teil\n" + "wort " * 500
    chunks = split.recursive(text, 200, 40)
    assert all(len(c) <= 200 for c in chunks) and all(w in " ".join(chunks) for w in ("Titel", "Teil", "wort", "eins"))
    assert split.recursive("", 10, 2) == [] and split.recursive("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    kinds = [k for _, _, k in split.spans("vor\n# Kopf\nText\n1. eins\nmehr")]
    assert kinds == ["intro", "header", "numbered_list", "outro"] and split.spans("a") == [(0, 1, "single_block")]
    assert one(spark, split.pack_words(F.lit("aa bb cc dd"), 6)) == ["aa bb", "cc dd"]
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    for s in split.STRATEGIES:
        assert split.split(d, s).where("doc_id = 1").count() > 0


def test_router(spark):
    q = spark.createDataFrame([(1, "Störung am Motor beheben"), (2, "zzz")], "query_id int, text string")
    got = {r.query_id: (r.query_type, r.strategy, r.k) for r in router.analyze(q).collect()}
    assert got == {1: ("troubleshooting", "hybrid", 7), 2: ("factual", "semantic", 3)}
    with pytest.raises(ValueError):
        router.Request(" ")
    assert router.Request("a", k=30).fetch_k == 60


def test_engine(spark, docs, small):
    e = router.Engine(docs, small, mode=None)
    for s in ("semantic", "keyword", "hybrid", "mmr", "multi", "adaptive", "unheard"):
        assert e.search(router.Request("pumpe defekt", k=2, strategy=s)).count() in (1, 2)


def test_context_window(spark):
    rows = [(1, i, r, "x" * 40) for i, r in enumerate(["system", "user", "assistant", "user"])]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in cx.context_window(m, 20).collect()) == [0, 2, 3]


def test_embed_once(spark):
    import pandas as pd

    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, text string")
    got = {r.i: r.embedding for r in cx.embed(d, lambda s: pd.Series([[float(len(x))] for x in s])).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: None}


@pytest.mark.parametrize("states,want", [([], "unknown"), (["unhealthy"], "degraded"), (["unhealthy"] * 2, "unhealthy"), (["critical", "healthy"], "critical"), (["healthy", "unknown"], "degraded"), (["healthy"], "healthy")])
def test_overall(spark, states, want):
    df = spark.createDataFrame([(s,) for s in states], "status string")
    assert mo.overall_status(df).first().status == want


def test_signed_knn_takes_all_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "vec_id long, embedding array<double>")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, vectors.signed_knn(rows, queries, 2).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.signed_knn(rows, queries, 2).collect())) == want and len(want) == 24


def test_literal_automaton_equals_contains(spark):
    words = ["", "a", "ab", "bab", "abc", "straße", "ß", "x" * 300, "ab", "%", "\n", "i̇"] + [f"w{i}" for i in range(200)]
    texts = [None, "", "BABAB", "xABCx", "STRASSE Straße", "y" * 50_000 + "abc", "x" * 299, "X" * 301, "100 %\n", "İ", "w19 W199", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    marked, has = literals.mark(df, "text", words)
    distinct = list(dict.fromkeys(words))
    both = marked.select("id", F.array(*map(has, distinct)).alias("got"), F.array(*(F.contains(F.lower("text"), F.lit(w)) for w in distinct)).alias("want"))
    rows = both.collect()
    assert len(rows) == len(texts) and all(r.got == r.want for r in rows) and any(any(r.got[100:]) for r in rows if texts[r.id])
    none, _ = literals.mark(df, "text", [])
    assert all(r["_marks"] == ([] if r.text is not None else None) for r in none.collect()) and literals.mark(df.limit(0), "text", words)[0].count() == 0


def test_rules_by_automaton_are_the_same(spark):
    rules = {n: r for n, r in (("base", lx.BASE_RULES), ("industrial", lx.INDUSTRIAL_RULES), ("software", lx.SOFTWARE_RULES))}
    some = [w for r in rules.values() for x in r for w in x.keywords]
    texts = [" ".join(some[i::17]) for i in range(17)] + [w.upper() for w in some] + [None, "", "1. eins 2. zwei", "nothing at all"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, _marks int")
    for name, r in rules.items():
        one, two = (cl.classify(df, rules=r, automaton=a).select("id", "_marks", F.to_json("classification").alias("c")).orderBy("id").collect() for a in (False, True))
        assert one == two and len({x.c for x in one}) > 5, name
