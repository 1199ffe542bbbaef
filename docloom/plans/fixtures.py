"""Registered queries over small literal tables, whose expected rows are worked out by hand from the definitions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import analyze as an
from docloom.operators import classify as cl
from docloom.operators import context as cx
from docloom.operators import enrich as en
from docloom.operators import fusion, index, keyword, router, vectors
from docloom.operators import models as mm
from docloom.operators import monitor as mo
from docloom.operators import split as sp
from docloom.plans.common import long, r6, sql_values

_MODES = [(1, "Die Wartung der SPS"), (2, "Druck 2,5 bar und 10 mm Motor"), (3, "Steuerungen für Ventile")]


def preprocess_modes(spark, sf):
    d = spark.createDataFrame(_MODES, "case_id long, text string")
    return d.select("case_id", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), tx.preprocess(F.col("text"), m).alias("out")) for m in tx.PREPROCESSING))).alias("x")).select("case_id", "x.mode", "x.out")


def query_terms(spark, sf):
    q = spark.createDataFrame([(1, "Wartung der SPS, Motor 2,5 kg"), (2, "Fehler am Ventil"), (3, "Pumpe und Sensor defekt")], "query_id long, text string")
    return q.select("query_id", F.array_join(tx.query_terms(F.col("text")), "|").alias("terms"))


def stems(spark, sf):
    d = spark.createDataFrame([(w,) for w in ("wartung", "fehler", "sicherheit", "pumpe", "motor", "es", "ebenen", "ungung")], "word string")
    return d.select("word", tx.stem_word(F.col("word")).alias("stem"))


_CORPUS = [(1, "pumpe defekt pumpe"), (2, "motor läuft"), (3, "ventil defekt"), (4, "lager alt")]


def _small(spark):
    d = spark.createDataFrame(_CORPUS, "doc_id long, text string")
    return index.build(d, mode=None, technical=keyword.technical(F.col("text"))), keyword.query_table(spark, {1: "pumpe defekt"}, mode=None)


def small_keyword_scores(spark, sf):
    """The default technical terms boost documents 1 to 3; idf of a term in half of the documents is 0."""
    ix, q = _small(spark)
    both = [keyword.search(ix, q, a, 10).select(F.lit(a).alias("algorithm"), "doc_id", r6("score").alias("score")) for a in ("bm25", "tf_idf")]
    raw = keyword.tfidf(ix, q, log_tf=False, smooth=False).select(F.lit("tf_idf_raw").alias("algorithm"), "doc_id", r6("score").alias("score"))
    return both[0].unionByName(both[1]).unionByName(raw)


def small_phrases(spark, sf):
    d = spark.createDataFrame([(1, " ".join(["rote pumpe", *["wort"] * 98])), (2, "pumpe rote"), (3, "")], "doc_id long, text string")
    found = keyword.phrase(d, '"rote Pumpe"').unionByName(keyword.phrase(d, '" "'))
    flags = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "beta")], "doc_id long, text string")
    for q in ("alpha AND beta", "alpha NOT beta", "gamma OR beta"):
        found = found.unionByName(keyword.boolean(flags, q).withColumn("doc_id", F.col("doc_id") + 100 * len(q)))
    return found.select("doc_id", r6("score").alias("score"))


def small_vectors(spark, sf):
    d = spark.createDataFrame([(1, [0.6, 0.8]), (2, [0.0, 0.0])], "vec_id long, v array<double>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    return d.select("vec_id", *(r6(fn(q, F.col("v"))).alias(name) for name, fn in vx.METRICS.items()), r6(vx.norm(vx.normalize(F.col("v")))).alias("unit"), vx.valid(F.col("v"), 2).alias("valid"))


def small_fusion(spark, sf):
    side = lambda rows: spark.createDataFrame([(1, d, s) for d, s in rows], "query_id int, doc_id string, score double")
    v, k = side([("a", 0.9), ("b", 0.8), ("c", 0.7)]), side([("b", 0.9), ("d", 0.8), ("a", 0.7)])
    w = fusion.weights(7 / 10, 3 / 10)
    rrf = fusion.fuse(v, k, "rrf", w=w).withColumn("how", F.lit("rrf"))
    weighted = fusion.fuse(side([("a", 0.9), ("b", 0.5)]), side([("b", 0.4), ("c", 0.2)]), "weighted").withColumn("how", F.lit("weighted"))
    neither = fusion.fuse(v.where("false"), k.where("false")).withColumn("how", F.lit("none"))
    alone = fusion.fuse(v, k.where("false")).withColumn("how", F.lit("alone"))
    return rrf.unionByName(weighted).unionByName(neither).unionByName(alone).select("how", "doc_id", r6("score").alias("score"))


def small_mmr(spark, sf):
    d = spark.createDataFrame([(1, "x", "alpha beta gamma", 0.9), (1, "y", "alpha beta gamma delta", 0.85), (1, "z", "epsilon zeta", 0.5)], "query_id int, doc_id string, content string, score double")
    return fusion.mmr(d, 2, 0.5).select("doc_id", r6("mmr").alias("mmr"), long("place").alias("place"))


def small_rerank(spark, sf):
    d = spark.createDataFrame([(1, "pumpe " + "x" * 1494), (2, "pumpe " + "x" * 54), (3, "kurz"), (4, "y" * 3001)], "case_id long, content string")
    return d.select("case_id", r6(fusion.rerank(F.lit(0.5), F.lit("pumpe ventil"), F.col("content"))).alias("score"))


_QUESTIONS = [(1, "Wie wird der Sensor kalibriert?"), (2, "Störung am Motor beheben"), (3, "technische Daten der Pumpe"), (4, "Unterschied Ventil und Aktor vs Servo Motor"), (5, "hello world"), (6, "warum wie was funktioniert das prinzip der steuerung in dieser anlage heute genau"), (7, "zuerst sensor, dann motor")]


def _asked(spark):
    return spark.createDataFrame(_QUESTIONS, "query_id long, text string")


def route_queries(spark, sf):
    q = router.analyze(_asked(spark))
    return q.select("query_id", "query_type", F.array_join("technical_terms", ",").alias("terms"), "strategy", long("k").alias("k"), "sequential")


def adaptive_weights(spark, sf):
    return fusion.adaptive_weights(_asked(spark)).select("query_id", r6("vector_weight").alias("vector_weight"), r6("keyword_weight").alias("keyword_weight"))


def expand_queries(spark, sf):
    q = spark.createDataFrame([(1, "Motor Fehler"), (2, "Ventil")], "query_id long, text string")
    out = None
    for how in ("synonyms", "domain", "multilingual", "none"):
        x = vectors.expand(q, how).select("query_id", F.lit(how).alias("how"), long("variant").alias("variant"), "text")
        out = x if out is None else out.unionByName(x)
    return out


def prepare_queries(spark, sf):
    d = spark.createDataFrame([(1, "  SPS und HMI "), (2, "Plan B"), (3, "x" * 600)], "query_id long, text string")
    return d.select("query_id", vectors.prepare_query(F.col("text")).alias("text"))


_TEXTS = [
    (1, "1. Gerät einschalten 2. Ventil drehen 3. Druck ablesen 4. Pumpe prüfen"),
    (2, "Installation der Anlage im Feld"),
    (3, "Spannung: 24V und Leistung: 150W"),
    (4, "Bei Problemen den Kundendienst rufen"),
    (5, "1. Eins 2. Zwei 4. Vier"),
    (6, "2. Zwei 1. Eins"),
    (7, "Profibus im Feld"),
    (8, "docker im Feld"),
    (9, "  "),
    (10, "1. Eins 99999999999999999999. Viel"),
]


def default_analysis(spark, sf):
    a = an.analyze(spark.createDataFrame(_TEXTS, "case_id long, text string"))
    x = F.col("analysis")
    return a.select("case_id", x["content_type"].alias("content_type"), x["has_steps"].alias("sequential"), long(x["step_count"]).alias("steps"), long(F.size(x["technical_terms"])).alias("terms"), r6(x["confidence"]).alias("confidence"))


def analyzer_presets(spark, sf):
    """The same texts by the industrial and the software word lists."""
    d = spark.createDataFrame(_TEXTS, "case_id long, text string").where("case_id IN (3, 7, 8)")
    return d.select("case_id", an.content_type(F.col("text"), lx.INDUSTRIAL_ANALYZER).alias("industrial"), an.content_type(F.col("text"), lx.SOFTWARE_ANALYZER).alias("software"))


_CLAIMS = [(1, "Warnung: unbedingt beachten"), (2, "zzz qqq"), (3, "Schritt 2 der Montage"), (4, "siehe Bild und Diagramm"), (5, "Hochspannung 20 kV"), (6, "GET /liste")]


def default_rules(spark, sf):
    """The base rules, and two presets on top of them; custom rules add to a category."""
    d = spark.createDataFrame(_CLAIMS, "case_id long, text string")
    out = None
    for name, rules in (("base", lx.BASE_RULES), ("industrial", lx.INDUSTRIAL_RULES), ("software", lx.SOFTWARE_RULES), ("custom", [*lx.BASE_RULES, lx.Rule("own", "documentation", ("qqq",), weight=0.5)])):
        c = cl.classify(d, rules=rules, content_type=F.lit("general"))
        k = F.col("classification")
        x = c.select("case_id", F.lit(name).alias("rules"), k["primary"].alias("category"), F.array_join(k["secondary"], ",").alias("secondary"), r6(k["total"]).alias("total"), F.array_join(k["flags"], ",").alias("flags"))
        out = x if out is None else out.unionByName(x)
    return out


def default_enrichment(spark, sf):
    d = spark.createDataFrame([(1, "Lebensgefahr! Warnung vor Hochspannung, 20 kV"), (2, None), (3, "Kalibrierung der Hydraulikpumpe bei 20 bar Druck")], "case_id long, text string")
    e = en.enrich(d)
    x = F.col("enrichment")
    return e.select("case_id", x["quality"].alias("quality"), x["safety"].alias("safety"), x["expertise"].alias("expertise"), x["domain"].alias("domain"), x["section"].alias("section"), x["prerequisites"].alias("prerequisites"))


def boosts(spark, sf):
    d = spark.createDataFrame([("excellent", "critical", ["has_procedures", "has_specifications"]), ("poor", "none", [])], "quality string, safety string, flags array<string>")
    return d.select("quality", "safety", r6(en.search_boost(F.col("quality"), F.col("safety"), F.col("flags"))).alias("boost"))


def hash_embeddings(spark, sf):
    d = spark.createDataFrame([("motor",), ("   ",)], "text string").select("text", vx.hash_embedding(F.col("text"), 40).alias("v"))
    at = lambda i: F.col("v")[i]
    return d.select("text", r6(at(0)).alias("e0"), r6(at(1)).alias("e1"), r6(at(2)).alias("e2"), (at(3) == at(35)).alias("repeats"))


def small_context_window(spark, sf):
    m = [(1, t, "user", "x" * 40) for t in range(3)] + [(2, 0, "system", "s" * 400), (2, 1, "user", "y" * 40), (2, 2, "user", "z" * 400)]
    d = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    return cx.context_window(d, 20).select("conv_id", "turn")


def health_rollup(spark, sf):
    cases = {"one": ["unhealthy", "healthy"], "two": ["unhealthy", "unhealthy"], "critical": ["critical", "healthy"], "degraded": ["degraded", "healthy"], "healthy": ["healthy", "healthy"], "mixed": ["healthy", "unknown"]}
    d = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "name string, status string")
    none = mo.overall_status(d.where("false")).select(F.lit("none").alias("name"), "status")
    return mo.overall_status(d, ["name"]).select("name", "status").unionByName(none)


def durations(spark, sf):
    d = spark.createDataFrame([(0.25,), (12.34,), (90.0,), (5400.0,)], "s double")
    return d.select("s", mo.duration(F.col("s")).alias("shown"))


_MANUAL = "Kopf der Anleitung hier\n\n## Aufbau\nTeil eins steht da.\n\nWARNUNG: heiß und laut\n\n- erstens\n- zweitens\n"


def splitters(spark, sf):
    """Chunks of one small manual by every strategy; separators stay at the start of what follows."""
    d = spark.createDataFrame([(1, _MANUAL)], "doc_id long, text string")
    out = None
    for name, more in (("stable", {"size": 40, "overlap": 0}), ("semantic", {"size": 200, "overlap": 0}), ("industrial", {"size": 40, "overlap": 0}), ("structural", {}), ("simple", {"size": 40})):
        x = sp.split(d, name, **more).select(F.lit(name).alias("strategy"), long("chunk_index").alias("chunk_index"), "text")
        out = x if out is None else out.unionByName(x)
    return out


def embedding_models(spark, sf):
    return mm.embedding_models(spark).select("model", long("dimension").alias("dimension"), long("context_length").alias("context_length"))


def request_checks(spark, sf):
    """What a request refuses or mends, and what keyword options reset."""
    out = []
    for name, values in (("blank", {"text": " "}), ("k", {"text": "a", "k": 0}), ("alpha", {"text": "a", "alpha": 1.5}), ("fetch", {"text": "a", "k": 30, "fetch_k": 10}), ("small", {"text": "a", "k": 5, "fetch_k": 3})):
        try:
            out.append((name, f"fetch_k={router.Request(**values).fetch_k}"))
        except ValueError:
            out.append((name, "refused"))
    for name, pair in (("weights", (0.0, 0.0)), ("weight", (1.5, 0.1)), ("share", (0.6, 0.2))):
        try:
            out.append((name, f"{fusion.weights(*pair)[0]:.2f}"))
        except ValueError:
            out.append((name, "refused"))
    o = keyword.Options(algorithm="other", k1=-1, b=2, fuzzy_least=5, ngram=(3, 1), mode="nothing")
    out.append(("options", f"{o.algorithm} {o.k1} {o.b} {o.fuzzy_least} {o.ngram} {o.mode}"))
    out.append(("sub_k", f"{fusion.per_side(5)} {fusion.per_side(1)} {fusion.per_side(0)}"))
    return spark.createDataFrame(out, "name string, result string")


QUERIES = [preprocess_modes, query_terms, stems, small_keyword_scores, small_phrases, small_vectors, small_fusion, small_mmr, small_rerank, route_queries, adaptive_weights, expand_queries, prepare_queries, default_analysis, analyzer_presets, default_rules, default_enrichment, boosts, hash_embeddings, small_context_window, health_rollup, durations, splitters, embedding_models, request_checks]

_S2, _S3 = "druck 2 5 bar druck und 10 millimet motor", "steuerung für ventil"
SQL = {
    "preprocess_modes": sql_values("case_id, mode, out", [
        (1, "basic", "die wartung der SPS Speicherprogrammierbare Steuerung"), (1, "stemming", "die wart der SPS Speicherprogrammierbar Steuer"), (1, "industrial", "die wart der SPS Speicherprogrammierbar Steuer"), (1, "multilingual", "die wart der SPS Speicherprogrammierbar Steuer"),
        (2, "basic", "druck 2 5 bar druck und 10 millimeter motor"), (2, "stemming", _S2), (2, "industrial", _S2), (2, "multilingual", f"{_S2} motor engine"),
        (3, "basic", "steuerungen für ventile"), (3, "stemming", _S3), (3, "industrial", _S3), (3, "multilingual", "steuerung control controller für ventil valve"),
    ]),
    "query_terms": sql_values("query_id, terms", [
        (1, "wart|der|SPS|Speicherprogrammierbar|Steuer|motor|kilogramm|wart der|der SPS|SPS Speicherprogrammierbar|Speicherprogrammierbar Steuer|Steuer motor|motor kilogramm|antrieb|maschine|aggregat"),
        (2, "fehl|am|ventil|fehl am|am ventil|absperrorgan|regelventil|stellglied"),
        (3, "pump|und|sensor|defekt|pump und|und sensor|sensor defekt|messfühler|detektor|aufnehmer"),
    ]),
    "stems": sql_values("word, stem", [("wartung", "wart"), ("fehler", "fehl"), ("sicherheit", "sicher"), ("pumpe", "pump"), ("motor", "motor"), ("es", "es"), ("ebenen", "eben"), ("ungung", "ung")]),
    "small_keyword_scores": sql_values("algorithm, doc_id, score", [
        ("bm25", 1, 0.142127), ("tf_idf", 1, 0.372677), ("tf_idf", 3, 0.110055),
        ("tf_idf_raw", 1, round(1.3 * (2 * math.log(4) + math.log(2)) / 20, 6)), ("tf_idf_raw", 3, round(1.3 * math.log(2) / 20, 6)),
    ]),
    "small_phrases": sql_values("doc_id, score", [(1, 0.5), (1401, 0.6), (1301, 0.35), (1303, 0.35)]),
    "small_vectors": sql_values("vec_id, cosine, dot, euclidean, manhattan, angular, unit, valid", [(1, 0.6, 0.6, 0.527864, 0.454545, 0.704833, 1.0, True), (2, 0.0, 0.0, 0.5, 0.5, 0.5, 0.0, True)]),
    "small_fusion": sql_values("how, doc_id, score", [
        ("rrf", "a", 0.016237), ("rrf", "b", 0.016208), ("rrf", "c", 0.011111), ("rrf", "d", 0.004839),
        ("weighted", "a", 0.7), ("weighted", "b", 0.3), ("weighted", "c", 0.0), ("alone", "a", 0.9), ("alone", "b", 0.8), ("alone", "c", 0.7),
    ]),
    "small_mmr": sql_values("doc_id, mmr, place", [("x", 0.9, 1), ("z", 0.25, 2)]),
    # half of the words in the text (.1) and among its first 100 characters (.05); length adds .05 from 50 to 1000, takes .1 below 20 and .05 above 3000
    "small_rerank": sql_values("case_id, score", [(1, 0.65), (2, 0.7), (3, 0.4), (4, 0.45)]),
    "route_queries": sql_values("query_id, query_type, terms, strategy, k, sequential", [
        (1, "procedural", "sensor", "mmr", 5, False), (2, "troubleshooting", "motor", "hybrid", 7, False), (3, "specification", "", "keyword", 5, False), (4, "comparative", "motor,aktor,servo", "hybrid", 5, False),
        (5, "factual", "", "semantic", 3, False), (6, "procedural", "steuerung", "mmr", 5, False), (7, "procedural", "motor,sensor", "mmr", 5, True),
    ]),
    "adaptive_weights": sql_values("query_id, vector_weight, keyword_weight", [(1, 0.7, 0.3), (2, 0.608696, 0.391304), (3, 0.7, 0.3), (4, 0.608696, 0.391304), (5, 0.5, 0.5), (6, 0.8125, 0.1875), (7, 0.7, 0.3)]),
    "expand_queries": sql_values("query_id, how, variant, text", [
        (1, "synonyms", 0, "Motor Fehler"), (1, "synonyms", 1, "antrieb fehler"), (1, "synonyms", 2, "maschine fehler"), (1, "synonyms", 3, "aggregat fehler"),
        (2, "synonyms", 0, "Ventil"), (2, "synonyms", 1, "absperrorgan"), (2, "synonyms", 2, "regelventil"), (2, "synonyms", 3, "stellglied"),
        (1, "domain", 0, "Motor Fehler"), (1, "domain", 1, "Motor Fehler wartung"), (1, "domain", 2, "Motor Fehler konfiguration"), (2, "domain", 0, "Ventil"), (2, "domain", 1, "Ventil wartung"), (2, "domain", 2, "Ventil konfiguration"),
        (1, "multilingual", 0, "Motor Fehler"), (1, "multilingual", 1, "engine drive fehler"), (1, "multilingual", 2, "motor error fault alarm"), (2, "multilingual", 0, "Ventil"), (2, "multilingual", 1, "valve"), (1, "none", 0, "Motor Fehler"), (2, "none", 0, "Ventil"),
    ]),
    "prepare_queries": sql_values("query_id, text", [(1, "sps speicherprogrammierbare steuerung und hmi human machine interface"), (2, "plan b"), (3, "x" * 512)]),
    "default_analysis": sql_values("case_id, content_type, sequential, steps, terms, confidence", [
        # all words of two letters or more are keywords, so each text with five of them gains .1
        (1, "step_by_step_guide", True, 4, 0, 1.0), (2, "installation_guide", False, 0, 0, 0.6), (3, "technical_specifications", False, 0, 2, 0.7), (4, "troubleshooting", False, 0, 0, 0.6), (5, "step_by_step_guide", False, 3, 0, 0.55),
        (6, "step_by_step_guide", False, 2, 0, 0.55), (7, "general", False, 0, 0, 0.55), (8, "general", False, 0, 0, 0.55), (9, "general", False, 0, 0, 0.0), (10, "step_by_step_guide", False, 2, 0, 0.55),
    ]),
    "analyzer_presets": sql_values("case_id, industrial, software", [(3, "technical_specifications", "technical_specifications"), (7, "technical_specifications", "general"), (8, "general", "installation_guide")]),
    # confidences are shares of a category's weights: .9 of 1.85 with the industrial safety rule, .3 of .8 with the custom one
    "default_rules": sql_values("case_id, rules, category, secondary, total, flags", [
        (1, "base", "safety", "compliance", 1.0, "has_warnings,requires_expertise"), (1, "custom", "safety", "compliance", 1.0, "has_warnings,requires_expertise"), (1, "industrial", "safety", "compliance", 0.743243, "has_warnings,requires_expertise"), (1, "software", "safety", "compliance", 1.0, "has_warnings,requires_expertise"),
        (2, "base", "documentation", "", 0.0, ""), (2, "custom", "documentation", "", 0.625, ""), (2, "industrial", "documentation", "", 0.0, ""), (2, "software", "documentation", "", 0.0, ""),
        (3, "base", "installation", "", 1.0, "has_diagrams,has_procedures"), (3, "custom", "installation", "", 1.0, "has_diagrams,has_procedures"), (3, "industrial", "installation", "", 1.0, "has_diagrams,has_procedures"), (3, "software", "installation", "", 1.0, "has_diagrams,has_procedures"),
        (4, "base", "documentation", "", 1.0, "has_diagrams"), (4, "custom", "documentation", "", 0.375, "has_diagrams"), (4, "industrial", "documentation", "", 1.0, "has_diagrams"), (4, "software", "documentation", "", 1.0, "has_diagrams"),
        (5, "base", "documentation", "", 0.0, ""), (5, "custom", "documentation", "", 0.0, ""), (5, "software", "documentation", "", 0.0, ""), (5, "industrial", "safety", "", 0.513514, "has_warnings,requires_expertise"),
        (6, "base", "documentation", "", 0.0, ""), (6, "custom", "documentation", "", 0.0, ""), (6, "industrial", "documentation", "", 0.0, ""), (6, "software", "specifications", "", 0.4, ""),
    ]),
    # 1: (.6 + 1) / 2 + .1 + .05 = .95; 2: the fallback; 3: (.6 + .8 / 1.2) / 2 + .1 + .05 = .78
    "default_enrichment": sql_values("case_id, quality, safety, expertise, domain, section, prerequisites", [
        (1, "excellent", "critical", "skilled", "electrical", "content", "Einweisung, Grundkenntnisse, Sicherheitsunterweisung"), (2, "poor", "none", "anyone", "general", "content", "Keine"),
        (3, "good", "none", "expert", "hydraulic", "content", "Fachausbildung, Zertifizierung, Berufserfahrung"),
    ]),
    "boosts": sql_values("quality, safety, boost", [("excellent", "critical", 2.0), ("poor", "none", 0.7)]),
    "hash_embeddings": sql_values("text, e0, e1, e2, repeats", [("motor", -0.984314, 0.192157, -0.560784, True), ("   ", 0.0, 0.0, 0.0, True)]),
    "small_context_window": sql_values("conv_id, turn", [(1, 1), (1, 2), (2, 0)]),
    "health_rollup": sql_values("name, status", [("none", "unknown"), ("one", "degraded"), ("two", "unhealthy"), ("critical", "critical"), ("degraded", "degraded"), ("healthy", "healthy"), ("mixed", "degraded")]),
    "durations": sql_values("s, shown", [(0.25, "250ms"), (12.34, "12.3s"), (90.0, "1.5min"), (5400.0, "1.5h")]),
    # what stands between two structural spans belongs to neither, as in the definition
    "splitters": sql_values("strategy, chunk_index, text", [
        *((s, i, t) for s in ("stable", "industrial") for i, t in enumerate(("Kopf der Anleitung hier", "## Aufbau\nTeil eins steht da.", "WARNUNG: heiß und laut", "- erstens\n- zweitens"))),
        ("semantic", 0, _MANUAL.strip()), *(("structural", i, t) for i, t in enumerate(("Kopf der Anleitung hier", "## Aufbau", "WARNUNG: heiß und laut", "- erstens", "- zweitens"))),
        *(("simple", i, t) for i, t in enumerate(("Kopf der Anleitung hier ## Aufbau Teil", "eins steht da. WARNUNG: heiß und laut -", "erstens - zweitens"))),
    ]),
    "embedding_models": sql_values("model, dimension, context_length", [("nomic-embed-text", 768, 2048), ("mxbai-embed-large", 1024, 512), ("snowflake-arctic-embed", 1024, 512), ("jina/jina-embeddings-v2-base-en", 768, 8192), ("sentence-transformers/all-MiniLM-L6-v2", 384, 256)]),
    "request_checks": sql_values("name, result", [
        ("blank", "refused"), ("k", "refused"), ("alpha", "refused"), ("fetch", "fetch_k=60"), ("small", "fetch_k=20"), ("weights", "refused"), ("weight", "refused"), ("share", "0.75"),
        ("options", "bm25 1.5 0.75 0.8 (1, 2) industrial"), ("sub_k", "7 1 1"),
    ]),
}
