"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat_format, components, decontam, embed_dedup, langid, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, queries
from docloom.llm.scratch import Scratch
from docloom.llm.words import Words, gram_hash, shingles
from tests.oracle import compare, connection

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside or give out.
CLASH = {"n_words": 1, "score": 2, "item": 3, "component_id": 4, "n": 5, "print": 6, "slot": 7, "copy": 8, "held_out": 9, "language": 10, "contamination": 11, "rank": 12, "a": 13, "b": 14, "fold": 15, "block": 16}


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank, wordless, very long, repeated and tied texts, and clashing columns."""
    rng = random.Random(3)
    vocab = [f"w{i}x" for i in range(400)]
    base = prose(rng, 120, vocab)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s1", 1), (2, base, "en", "s1", 1), (3, " ".join(near), "en", "s2", 1), (3, " ".join(near), "en", "s2", 1), (4, None, None, None, None), (None, base, "en", "s1", 1), (None, None, None, None, None),
        (5, "", "fr", "s1", 0), (6, " \t\n \x0b ", "fr", "s3", 3), (7, "!!! ... ???", "de", None, 9), (8, "one two", "en", "s1", 7), (9, "one two", "de", "s2", 7), (10, "ONE\ntwo", "en", "s2", 7),
        (11, prose(rng, 60_000, vocab), "en", "s1", 1), (12, "x" * 300_000, "en", "s1", 1), (13, "é ü ß 漢字 العربية " * 30, "de", "s4", 1), (14, base.upper(), "en", "s1", 1), (15, "line one here 17\n" * 40, "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def collected(df):
    return df.orderBy("doc_id").collect()


def test_words_match_regexes():
    import re

    texts = ["Ab  c", None, "", "x-y Z9", "é A\x0bb", "a\n", "\x00q"]
    for kind, pattern in (("spaced", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts, pa.string()), kind)
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert w.counts().tolist() == [len(x) for x in want]
        assert [w.word(i).decode() for i in range(len(w.start))] == [x for t in want for x in t]
    w = Words(pa.array(["aa bb aa", "bb"], pa.string()), "spaced")
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[1]
    assert len(gram_hash(w.hash, 9)) == 0 and [len(s) for s in shingles(w, 2)] == [2, 1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 230)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(5, 5)]
    u = ngram_join.Union(400)
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# 1


def test_chain_of_any_stretch():
    """Marginals of whole texts do not depend on the length of the stretches they are computed in."""
    rng = np.random.default_rng(0)
    bounds = np.concatenate(([0], np.cumsum([0, 700, 3, 129, 128, 256, 1, 0, 5])))
    score, move, first = rng.normal(size=(bounds[-1], 4)) * 2, rng.normal(size=(4, 4)), rng.normal(size=4)
    want = langid.chain(score, *langid.segments(bounds, 10**6), move, first)[0]
    for size in (1, 2, 7, 128, 1000):
        assert np.allclose(langid.whole_chain(score, bounds, move, first, size), want)


def test_language_id(spark, corpus, edge, empty):
    model = langid.train(corpus)
    got = langid.predict(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count() and {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 7)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"}


def test_chain_is_exact():
    """Forward-backward against enumeration of all labellings."""
    import itertools

    rng = np.random.default_rng(0)
    e, move, first = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want, total = np.zeros((5, 3)), 0.0
    for y in itertools.product(range(3), repeat=5):
        p = math.exp(first[y[0]] + sum(e[i, y[i]] for i in range(5)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        total += p
        for i in range(5):
            want[i, y[i]] += p
    got, _, log_z = langid.chain(e, np.array([0]), np.array([5]), move, first)
    assert np.allclose(got, want / total) and log_z == pytest.approx(math.log(total))


def test_code_switching(spark, corpus):
    model = langid.train(corpus)
    text = "the and of that with for this is are the " * 3 + "und der die nicht ist mit ein eine auf sich " * 3
    t = langid.Tokens([text])
    best = model.marginals(t).argmax(axis=1)
    half = len(best) // 2
    assert (best[:half] == model.labels.index("en")).mean() > 0.8 and (best[half:] == model.labels.index("de")).mean() > 0.8


# 2


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16))
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(60)]
    rows += [(100 + i, [float(x) for x in centers[i % 8] + 0.12 * rng.normal(size=16)]) for i in range(120)]
    rows += [(300 + i, [1.0] * 16) for i in range(5)] + [(300, [1.0] * 16), (400, None), (401, [0.0] * 16), (402, [math.nan] * 16), (403, [None] * 16), (404, []), (405, [2.0] * 8), (406, [1e200] * 8), (407, [math.inf] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = embed_dedup.near_duplicates(df, block=32, window=8, part=16).collect()
    want = embed_dedup.brute_force([r for r in rows if r != (300, [1.0] * 16)])
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None and not 300 <= r.vec_id < 310:
            assert (r.n_links, r.component_id) == want[r.vec_id]
    assert {(r.n_links, r.component_id) for r in got if r.vec_id and 300 <= r.vec_id < 310} == {(5, 300)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_in_a_cone(spark):
    """A third of the vectors is a cone of mutual cosine .86, with planted pairs at .955: crowded keys lose no pair."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, n, pairs = unit(rng.standard_normal((4500, 64))), 1500, 200
    axis = unit(rng.standard_normal(64))
    side = unit((v := rng.standard_normal((n, 64))) - (v @ axis)[:, None] * axis)
    x[:n] = math.sqrt(0.86) * axis + math.sqrt(0.14) * side
    away = unit((v := rng.standard_normal((pairs, 64))) - (v * x[:pairs]).sum(axis=1)[:, None] * x[:pairs])
    x[n : n + pairs] = 0.955 * x[:pairs] + math.sqrt(1 - 0.955**2) * away
    hit = x @ x.T >= embed_dedup.COSINE
    u = ngram_join.Union(len(x))
    for a, b in np.argwhere(hit).tolist():
        u.join(a, b)
    want = {i: (int(hit[i].sum()) - 1, u.find(i)) for i in range(len(x))}
    assert sum(k for k, _ in want.values()) >= 2 * pairs
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for more in ({}, {"exact": 100}):  # all pairs of what is open, and wider windows before
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, window=8, block=256, **more).collect()}
        assert got == want


# 3


def test_ngram_join(spark, corpus, edge, empty):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(3000)]
    rows, passage = [], prose(rng, 40, vocab)
    for g in range(12):  # groups of copies with random edits, many about the threshold, that share passages
        base = prose(rng, rng.randrange(6, 150), vocab).split() + (passage.split() if g % 3 == 0 else [])
        for _ in range(rng.randrange(2, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "a b c", "A B c", "a b c d e", "a b c d e f", "  "])]
    want = ngram_join.brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"group": 400, "task": 300}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, **more).collect()} == want
    small = [(r.doc_id, r.text) for r in corpus.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(corpus).collect()} == ngram_join.brute_force(small)
    got = ngram_join.join(edge).collect()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert len(got) == edge.count() and by[1] == by[2] == by[14] == 1 and by[3] == 1 and by[8] == by[9] == by[10] == 8 and all(by[i] == i for i in (4, 5, 6, 7, 11, 12, 13))
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.join(empty).count() == 0


def test_ngram_candidates(spark):
    """A pair that shares 62 of 64 shingles under a small pivot and 21 under each of two large ones is tested; less than the mean is not."""
    ties = [(1, c, 100, 62, 64, 2) for c in (101, 102)] + [(p, c, 100, 21, 64, 20) for p in (2, 3) for c in (101, 102)]
    ties += [(11, c, 100, 62, 64, 2) for c in (111, 112)] + [(21, c, 100, 21, 64, 2) for c in (121, 122)] + [(p, c, 100, 21, 64, 20) for p in (2, 3) for c in (121, 122)]
    got = ngram_join.candidates(spark.createDataFrame(ties, "p long, c long, n long, shared long, least long, m long"))
    assert sorted((r.p, r.c) for r in got.collect()) == [(1, 101), (1, 102)]


def test_ngram_join_of_common_passages(spark):
    """Near copies whose text is part own, part passages of more than 16 documents, with changes in both."""
    rng = random.Random(21)
    vocab = [f"t{i}" for i in range(4000)]
    passages = [prose(rng, 45, vocab).split() for _ in range(4)]
    rows = []
    for g in range(28):
        base = prose(rng, rng.randrange(30, 160), vocab).split() + [w for x in rng.sample(passages, rng.randrange(1, 4)) for w in x]
        for _ in range(rng.randrange(1, 4)):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == ngram_join.brute_force(rows)


# 4


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo\nline"), (1, 2, "user", "more"), (1, 3, "assistant", "<|im_end|>\\ <|x \\| \\\\"), (2, 0, "system", "only"), (3, 0, "assistant", None), (3, 1, None, "x"), (3, None, "user", "first"),
        (4, 0, "a\\n\nb<|", "r"), (4, 0, "a\\n\nb<|", "r"), (None, 0, "assistant", "null id"), (5, 0, "user", "u"), (5, 1, "assistant", ""), (6, 0, "assistant", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    out = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    first = out.where("conv_id = 1 AND example = 1").first()
    assert first.text.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo") and first.text[first.loss_start : first.loss_end] == "<\\|im_end|>\\\\ <\\|x \\\\| \\\\\\\\"
    assert out.where("conv_id = 1").count() == 2 and out.where("conv_id = 2 AND loss_start = loss_end").count() == 1
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0


def test_chat_of_many_turns(spark):
    n = 20_000  # two examples: the reply in the middle and the one at the end
    many = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") % n).alias("turn"), F.when(F.col("id").isin(n // 2, n - 1), "assistant").otherwise("user").alias("role"), F.concat(F.lit("a<|b "), F.col("id").cast("string")).alias("text"))
    pieces = [f"<|im_start|>{'assistant' if i in (n // 2, n - 1) else 'user'}\na<\\|b {i}<|im_end|>\n" for i in range(n)]
    out = chat_format.examples(many.repartition(3)).orderBy("example").collect()
    for r, last in zip(out, (n // 2, n - 1), strict=True):
        assert r.text == "".join(pieces[: last + 1]) and r.text[r.loss_start : r.loss_end] == f"a<\\|b {last}"


# 5


def test_mixing(spark, corpus, edge, empty):
    p = mixing.plan(corpus).collect()
    per: dict = {}
    for r in p:
        per.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert sum(v[1] for v in per.values()) == pytest.approx(1.5 * sum(v[0] for v in per.values())) and all(v[1] <= 2 * v[0] + 1e-6 for v in per.values())
    assert {r.doc_id: r.taken for r in p} == {r.doc_id: r.taken for r in mixing.plan(corpus.repartition(7)).collect()}
    mixed = mixing.mix(corpus).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in p if r.copies}
    assert mixing.plan(edge).count() == edge.count() and mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert "_copy" in mixing.mix(edge).columns and {r.size for r in mixing.plan(edge).where("doc_id IN (4, 5, 6)").collect()} == {0}


def test_mixing_targets(spark):
    """Water filling against the plain loop."""
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 400, None: 10, "e": 0}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in sizes if s), None])}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        left -= sum(want[s] for s in over)
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == {s: pytest.approx(v) for s, v in want.items()}


# 6


def test_lm_score(spark, corpus, edge, empty):
    rows = corpus.limit(60).collect()
    want = {r.doc_id: w for r, w in zip(rows, lm_score.brute_force([r.text for r in rows]), strict=True)}
    for more in ({}, {"block": 20_000, "bucket": 5_000}):
        got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows), **more).collect()}
        assert all(got[d].n_words == n and got[d].log_total == pytest.approx(s) for d, (n, s) in want.items())
    want = {r.doc_id: w for r, w in zip(rows, lm_score.brute_force([r.text for r in rows], leave_out=True), strict=True)}
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows), leave_out=True).collect()}
    assert all(got[d].n_words == n and got[d].log_total == pytest.approx(s) for d, (n, s) in want.items())
    got = lm_score.score(edge).collect()
    assert len(got) == edge.count() and all((r.score is None) == (r.n_words == 0) for r in got) and all(r.score <= 0 for r in got if r.n_words)
    assert lm_score.score(empty).count() == 0


def test_lm_score_tells_copies_apart(spark):
    """Left out of the counts, texts that occur twice score above those that occur once."""
    rng = random.Random(2)
    texts = [prose(rng, 60, [f"v{i}" for i in range(300)]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:10])]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), leave_out=True).collect()
    twice = [r.score for r in got if r.doc_id < 10 or r.doc_id >= 60]
    assert min(twice) > max(r.score for r in got if 10 <= r.doc_id < 60)


# 7


def test_quality(spark, sf, corpus, edge, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(corpus, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 1, 0)], labels.schema))
    rows = quality.score(edge, messy).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(edge, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    x, y = quality.isotonic(np.arange(5), np.array([2, 2, 2, 2, 2]), np.array([0, 2, 1, 1, 2]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and len(y) == 3


# 8


def test_license_scan(spark, edge, empty):
    rows = [
        (1, "Released under the MIT License. Also UNDER-THE mit license!"), (2, "Licensed under the Apache License, Version 2.0."), (3, "cc by nc 4.0 or cc-by-nc"), (4, "GNU General Public License, version 3 or any later version"),
        (5, "nothing here"), (6, None), (7, "mit license"), (8, "permission is hereby granted free of charge to any person obtaining a copy of this software"), (9, "under the mit " * 3000),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 1, 6, "mit", "mit")
    assert got[2].base_labels == "apache-2" and got[2].labels == "apache-2,apache-2.0"
    assert got[3].n_base == 2 and got[3].labels == "cc-by-nc,cc-by-nc-4.0"
    assert got[4].labels == "gpl-3.0-or-later" and got[4].n_base == 0 and got[4].first_word is None and got[4].score > 0.9
    assert (got[5].labels, got[5].score, got[6].n_words, got[7].labels, got[8].labels, got[9].n_base) == ("", 0.0, 0, "mit", "mit", 0)
    assert license_scan.scan(edge).count() == edge.count() and license_scan.scan(empty).count() == 0
    assert len(license_scan.rules()) > 300


def _wordings(items) -> list[str]:
    """All texts that a parsed pattern without open repeats matches."""
    out = [""]
    for kind, x in items:
        name = str(kind)
        if name == "LITERAL":
            ways = [chr(x)]
        elif name == "IN":
            ways = ["2" if str(k) == "CATEGORY" else chr(v) for k, v in x]
        elif name == "ANY":
            ways = ["x"]
        elif name == "BRANCH":
            ways = [w for y in x[1] for w in _wordings(y)]
        elif name == "MAX_REPEAT":
            assert x[:2] == (0, 1) or x[0] == 1
            ways = [*[""] * (x[0] == 0), *_wordings(x[2])]
        else:
            assert name == "SUBPATTERN"
            ways = _wordings(x[3])
        out = [o + w for o in out for w in ways]
    return out


def test_license_alternatives_pass_their_gate(spark):
    """A rule is only tried on texts with its keywords, so each of its wordings has them."""
    from re import _parser

    every = [(r, t) for r in license_scan.rules() for t in _wordings(_parser.parse(r.pattern))]
    assert all(r.keywords for r, _ in every)
    assert [(r.label, t) for r, t in every if not set(t.split()).issuperset(r.keywords)] == []
    assert [(r.label, t) for r, t in every if r.label not in {d[2].label for d in license_scan.scan_words(t.split(), set(t.split()))}] == []
    rows = [(1, "licensed under the PSF license"), (2, "Python Software Foundation License")]
    assert {r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {"python-2.0"}


def test_license_scan_against_all_rules_everywhere(spark, corpus, edge):
    """Base phrases and labels of whole texts, without gate, hashes or ordered suppression."""
    from re import _parser

    rng = random.Random(6)
    lines = [t for r in license_scan.rules() for t in _wordings(_parser.parse(r.pattern))[-1:]] + list(license_scan.BASE)
    mixed = [(100_000 + i, f" {prose(rng, 5, ['the', 'under', 'license', 'of'])}. ".join(rng.choice(lines) for _ in range(1 + i % 4))) for i in range(120)]
    docs = corpus.select("doc_id", "text").unionByName(edge.where("doc_id IS NOT NULL").select((F.col("doc_id") + 200_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame(mixed, "doc_id long, text string"))
    rows = docs.collect()
    got = sorted(tuple(r)[:8] for r in license_scan.scan(docs).collect())
    assert got == sorted((r.doc_id, *b) for r, b in zip(rows, license_scan.brute_force([r.text for r in rows]), strict=True))
    assert len({x for g in got for x in g[6].split(",")}) > 60


def test_suppression():
    r = lambda p: license_scan.Rule("x", "y", (), p, 1.0)
    found = [(0, 10, r(50), 0), (2, 5, r(30), 1), (2, 5, r(60), 2), (0, 10, r(50), 3), (9, 12, r(10), 4)]
    assert [(d[0], d[1], d[3]) for d in license_scan.suppress(found)] == [(0, 10, 0), (2, 5, 2), (9, 12, 4)]


# 9


def test_decontamination(spark, sf, corpus, edge, empty):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(900, "one two"), (901, None), (902, ""), (None, "x9 y9 z9"), (903, "w1x"), (903, "w2x")], items.schema)
    both = items.unionByName(odd)
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(9001, "ONE-two, one two"), (9002, "x9 y9 z9"), (9003, "w1x w2x w1x"), (9004, None), (9005, "")], "doc_id long, text string"))
    rows, its = docs.collect(), [(r.item_id, r.text) for r in both.collect()]
    want = dict(zip([r.doc_id for r in rows], decontam.brute_force([r.text for r in rows], its), strict=True))
    for more in ({}, {"block_words": 60}):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.digest(decontam.decontaminate(docs, both, **more)).collect()}
        assert got == want
    assert want[9001][1:3] == (4, 1) and want[9002][1:3] == (3, 0) and want[9003][1:3] == (3, 1)
    assert decontam.decontaminate(edge, both).count() == edge.count() and decontam.decontaminate(empty, both).count() == 0
    assert {r.contaminated for r in decontam.decontaminate(edge, items.limit(0)).collect()} == {False}
    marked, name = decontam.mark(edge, both)
    assert name == "_contamination" and marked.columns == [*edge.columns, name]


# 10


def test_line_dedup(spark, corpus, edge, empty):
    rng = random.Random(4)
    vocab = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    common = prose(rng, 55, vocab)
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.randrange(1, 30), vocab) for _ in range(4)]
        if i % 5 == 0:
            lines.insert(2, common)
        if i % 4 == 0:
            lines.append(f"user session number {i} opened at 10:{i}")
        if i % 7 == 0:
            lines.append(f"the quick server named {rng.choice(vocab)} has restarted without any error today")
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, rows[0][1]), (54, rows[1][1])]
    want = line_dedup.brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"part": 1}):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(df, **more).collect()}
        assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}
    assert all(common not in got[i][2] for i in range(0, 40, 5))
    small = [(r.doc_id, r.text) for r in corpus.collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(corpus).collect()}
    assert got == {d: w for (d, _), w in zip(small, line_dedup.brute_force(small), strict=True)}
    assert line_dedup.dedup(edge).count() == edge.count() and line_dedup.dedup(empty).count() == 0


def test_line_dedup_of_documents_that_differ_in_digits(spark):
    """Three pages of one log template are three texts, three copies of one page are one."""
    page = lambda i: f"job {i} on node {i % 4} failed at 10:{i}\nretry number {i} of the job has ended"
    rows = [(i, page(10 + i)) for i in range(3)] + [(10 + i, "the very same line stands in copies\nand so does this other one") for i in range(3)] + [(20, page(10).upper())]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: w for (d, _), w in zip(rows, line_dedup.brute_force(rows), strict=True)}
    assert got[0] == got[1] == got[2] == got[20] == (2, 2, "") and all(got[10 + i][1] == 0 for i in range(3))


def test_line_dedup_of_close_templates(spark, edge):
    """Leaves of many lines whose templates lie close together, with several variable fields; the size of a part changes nothing."""
    rng = random.Random(8)
    name = lambda: f"n{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    rows = []
    for i in range(150):
        lines = [f"the host {rng.choice(['was', 'has'])} seen by {name()} and {name()} in the {rng.choice(['old', 'new', name()])} hall at noon today again"]
        lines.append(f"a short line {rng.choice('abcdefgh')} {rng.choice('stuvw')}")
        lines.append(" ".join(["the", "host", "was"] + [rng.choice("pqrs") for _ in range(9)]))
        lines.append(f"count {rng.choice(['17', 'seven', name()])} of the host was {name()} and then no more")
        rows.append((None if i % 10 == 0 else i // 2, "\n".join(lines[: rng.randrange(1, 5)])))
    want = sorted(line_dedup.brute_force(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1, 7, 40, 1 << 15):
        assert sorted((r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(df.repartition(1 + part % 9), part=part).collect()) == want
    assert 40 < sum(k for _, k, _ in want) < sum(n for n, _, _ in want)
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = [(r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(edge).collect()]
    assert sorted(got, key=str) == sorted(line_dedup.brute_force(rows), key=str)


@pytest.fixture(scope="module")
def edge_sf(edge, sf, tmp_path_factory):
    """The edge rows that have an id, as the documents of a folder beside the other tables."""
    at = tmp_path_factory.mktemp("edge")
    edge.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars").distinct().coalesce(1).write.parquet(f"{at}/raw")
    next((at / "raw").glob("part-*.parquet")).rename(at / "documents.parquet")
    for name in ("benchmark", "embeddings", "conversations", "labels"):
        (at / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["op3_ngram_join", "op5_mix_sources", "op9_decontaminate"])
def test_sql_on_edges(name, spark, edge_sf, sf):
    """Nulls, empty, wordless, very long and tied texts, by SQL."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{edge_sf}/{t}.parquet'")
    compare(queries.queries()[name](spark, edge_sf), queries.oracle_sql()[name], con)


def test_mix_draws_by_text(spark):
    """Rows that share an id, or have none, do not draw alike: a source of them meets its target."""
    rows = [(i, f"own {i}", "a") for i in range(200)] + [(None if i % 2 else 7, f"text number {i} of the source", "b") for i in range(4000)] + [(i, f"word {i}", "c") for i in range(200)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'b'").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.countDistinct("copies").alias("kinds")).first()
    assert abs(got.taken - got.target) < 0.05 * got.target and got.kinds == 2


def test_embeddings_single_double_and_large_groups(spark):
    """The same links whatever the precision's type and the size of a block; one group holds most vectors."""
    rng = np.random.default_rng(4)
    group = rng.standard_normal(24) + 0.12 * rng.standard_normal((150, 24))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.concatenate([group, rng.standard_normal((60, 24)), group[:3]]))]
    want = embed_dedup.brute_force(rows)
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        for more in ({}, {"part": 16, "block": 70}):
            assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, **more).collect()} == want
    assert max(n for n, _ in want.values()) > 100


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf):
    compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connection(sf))


@pytest.mark.parametrize("across", [False, True])
def test_bins_leave_out_chance_members_only(monkeypatch, across):
    """Members met by chance once sent their whole sets to be verified."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3000, 2900, 1, 40, 500, 3000)]
    near = np.unique(np.concatenate((sets[4][60:], rng.integers(0, 1 << 63, 10).astype(np.uint64))))
    sets += [near, sets[3].copy()]
    side = np.arange(len(sets)) // 4
    n = np.array([len(s) for s in sets])
    kept = lambda: set(np.flatnonzero(ngram_join.hopeful(np.stack([ngram_join.unbinned(ngram_join.binned(s)) for s in sets]), n, side, across, 75)).tolist())
    linked = {x for x, a in enumerate(sets) for y, b in enumerate(sets) if x != y and not (across and side[x] == side[y]) and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    assert linked == ({3, 7} if across else {3, 4, 6, 7}) and kept() == linked
    monkeypatch.setattr(ngram_join, "UNCOUNTED", 2950)
    assert kept() == linked | {0, 1, 5}
