import random

import pytest
from pyspark.sql import functions as F

from docloom.plans import catalog
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, con):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql:
        compare(df, sql, con)
    else:
        assert df.count() >= 0


def test_long_documents_are_split_and_ingested(spark, tmp_path):
    """Every document, long ones and those without n_chars too, against plain Python."""
    from docloom.operators.split import recursive

    texts = {1: "short text here", 2: "lorem ipsum dolor sit amet " * 300, 3: "one more. " * 250, 4: None, 5: "without a count " * 400, 6: ""}
    rows = [(d, t, "en", "s", None if d == 5 else len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def packed(text, size):
        out = []
        for w in text.split():
            if out and len(out[-1]) + 1 + len(w) <= size:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    words = {d: packed(t or "", 200) for d, t in texts.items()}
    got = {r.doc_id: (r.chunks, r.chars) for r in catalog.queries()["split_words"](spark, str(tmp_path)).collect()}
    assert got == {d: (len(c), sum(map(len, c))) for d, c in words.items() if c}
    chunks = [c for t in texts.values() if t is not None for c in recursive(t)]
    got = catalog.queries()["ingest_chunks"](spark, str(tmp_path)).collect()
    assert sum(r.chunks for r in got) == len(chunks) and sum(r.chunks * r.avg_length for r in got) == pytest.approx(sum(map(len, chunks)), abs=0.01)


@pytest.mark.parametrize(("least", "window"), [(0.1, 256), (0.25, 2), (0.3, 256), (0.5, 1), (0.6, 3), (0.75, 256)])
def test_related_chunks_against_all_pairs(spark, least, window):
    from docloom.operators.enrich import related_chunks

    rng = random.Random(5)
    rows = [(s, i, rng.choice("ab"), rng.choice("xyz"), [rng.choice("klmnopq") for _ in range(rng.randrange(5))]) for s in range(3) for i in range(25)]

    def score(a, b):
        shared = len(set(a[4]) & set(b[4])) / max(len(set(a[4])), len(set(b[4])), 1)
        return round(0.3 * (a[2] == b[2]) + 0.4 * shared + 0.2 * (a[3] == b[3]) + 0.1 * (abs(a[1] - b[1]) <= 2), 9)

    want = {(a[0], a[1]): [b[1] for b in rows if a[0] == b[0] and a[1] != b[1] and score(a, b) >= least][:5] for a in rows}
    got = related_chunks(spark.createDataFrame(rows, "source int, chunk_index int, category string, domain string, keywords array<string>"), least, window=window)
    assert {(r.source, r.chunk_index): r.related for r in got.collect()} == {k: v for k, v in want.items() if v}


def _pairs_met(spark, n, keywords):
    """Rows that joins made when chunks of one source with such keywords were related, and the result."""
    from docloom.operators.enrich import related_chunks

    rows = [("s", i, f"c{i % 3}", f"d{i % 7}", keywords(i)) for i in range(n)]
    seen, store = [], spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _list(spark, store.executionsList())}
    got = {r.chunk_index: r.related for r in related_chunks(spark.createDataFrame(rows, "source string, chunk_index int, category string, domain string, keywords array<string>"), 0.75).collect()}
    for e in _list(spark, store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in _list(spark, store.planGraph(e.executionId()).allNodes()):
                if "Join" in node.name():
                    seen += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in _list(spark, node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return max(seen, default=0), got


def _list(spark, seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_related_chunks_meet_pairs_in_proportion_to_rows(spark):
    """A word in all chunks, with rarer ones beside it, or in sets that are all related."""
    common = [_pairs_met(spark, n, lambda i: ["all", f"a{i}", f"b{i}", f"c{i}"]) for n in (300, 1200)]
    assert [len(g) for _, g in common] == [0, 0] and common[1][0] < 6 * max(common[0][0], 300 * 5)
    alike = [_pairs_met(spark, n, lambda i: ["all", "one"]) for n in (600, 2400)]
    assert [len(g) for _, g in alike] == [600, 2400] and alike[1][0] < 6 * alike[0][0]
    assert alike[1][1][1000] == [13, 34, 55, 76, 97]  # those of equal labels


def _rule(rule, text):
    import re

    low = text.lower()
    found = [k in low for k in rule.keywords]
    patterns = [re.search(p, text, re.IGNORECASE | re.MULTILINE) is not None for p in rule.patterns]
    return (all(found) and (any(patterns) or not patterns)) if rule.requires_all and found else any(found + patterns)


def test_default_rules_against_plain_python(spark, sf):
    """The base rules and both presets over all documents, with confidences: no SQL, as their patterns need word edges of all scripts."""
    from docloom.functions import lexicon as lx
    from docloom.plans import defaults

    texts = {r.doc_id: r.text for r in defaults._manuals(spark, sf).collect()}
    types = {r.doc_id: r["default"] for r in defaults.default_analysis_table(spark, sf).collect()}
    want = {}
    for name, rules in (("base", lx.BASE_RULES), ("industrial", lx.INDUSTRIAL_RULES), ("software", lx.SOFTWARE_RULES)):
        order = list(dict.fromkeys(r.category for r in rules))
        for d, t in texts.items():
            hit = [r for r in rules if _rule(r, t)]
            score = {c: sum(r.weight for r in hit if r.category == c) for c in order}
            share = {c: min(1.0, score[c] / sum(r.weight for r in rules if r.category == c)) for c in order if score[c] > 0}
            best = sorted(share, key=lambda c: (-round(score[c], 9), order.index(c)))
            want[d, name] = (
                best[0] if best else lx.CATEGORY_OF_TYPE[types[d]],
                ",".join(c for c in best[1:] if round(score[c], 9) >= 0.3),
                round(sum(share.values()) / len(share), 6) if share else 0.0,
                ",".join(sorted({f for r in hit for f in r.flags})),
                {c: round(v, 5) for c, v in share.items()},
            )
    got = {}
    for r in defaults.default_classification(spark, sf).collect():
        shares = {c: round(float(v), 5) for c, v in (x.split("=") for x in r.confidences.split(",") if x)}
        got[r.doc_id, r.rules] = (r.category, r.secondary, r.total, r.flags, shares)
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k][:2] + got[k][3:] != want[k][:2] + want[k][3:] or abs(got[k][2] - want[k][2]) > 2e-6] == []
    assert len({w[0] for w in want.values()}) >= 5


def test_technical_terms_count_units_as_the_sql_does(spark, tmp_path):
    """A unit behind a hash, beside others: the query follows its SQL, the operator keeps the word edge."""
    import duckdb

    from docloom.operators import analyze

    texts = ["hash 4c0ddd8a here", "12 V and 3.5 GHz", "x8a 8a", "9dd8a. USB", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    compare(catalog.queries()["technical_terms"](spark, str(tmp_path)), catalog.oracle_sql()["technical_terms"], c)
    got = {r.doc_id: r.t for r in docs.select("doc_id", analyze.technical_terms(F.col("text")).alias("t")).collect()}
    assert got[0] == [] and got[3] == ["USB"]


def test_sql_names_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
