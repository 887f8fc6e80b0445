"""Routing, grounding, retrieval, vectors, exports, streams."""

import json
import tracemalloc
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oncolattice.catalog import inputs
from oncolattice.functions import substring_join
from oncolattice.operators import grounding as gr, rdf, retrieval as t, routing as r, vectors as vec
from oncolattice.plans import answer, build as bld
from oncolattice.sources import sinks, vocabulary as v
from oncolattice.streaming import ingest, threads

Q = "query string, has_case boolean, router_raw string, ran array<string>, iteration int"


@pytest.mark.parametrize("raw,expected", [
    ('["diagnostic"]', ["diagnostic"]), ('I pick ["evidence", "odd"] today', ["evidence"]), ("nothing", ["explanation"]),
    ('["explanation"] or ["validation"]', ["validation"]), ('<think>["validation"]</think> none', ["explanation"]), ('["a"] [oops', ["explanation"])])
def test_router_output(spark, raw, expected):
    assert r.route(spark.createDataFrame([("why so", False, raw, [], 0)], Q)).first()["target_agents"] == expected


def test_next_agent(spark):
    rows = [("", False, '["diagnostic","evidence"]', ran, 0) for ran in ([], ["diagnostic"], ["diagnostic", "evidence"])]
    rows.append(("", False, json.dumps(r.AGENTS), [], 0))
    out = r.next_step(r.route(spark.createDataFrame(rows, Q))).collect()
    assert [x["next_agent"] for x in out] == ["diagnostic", "evidence", "synthesize", "diagnostic"]
    assert len(out[3]["planned_agents"]) == 4
    assert len(r.next_step(r.route(spark.createDataFrame(rows[3:], Q)), 3).first()["planned_agents"]) == 3


def checked(spark, text, ihc=None, ish=None, case=True):
    df = spark.createDataFrame([(text, ihc, ish, [], case)], "response string, ihc_score string, ish_group string, context_labels array<string>, has_case boolean")
    return gr.check(df).first()


def test_grounding(spark):
    assert checked(spark, "Per ASCO the case is HER2-Low, IHC 1+.").is_grounded
    bad = checked(spark, "It is HER2-Negative and IHC 5+.")
    assert len(bad["violations"]) == 2 and bad["severity"] == "HIGH" and bad["penalty"] == 0.3 and "-30%" in bad["summary"]
    assert checked(spark, "This is HER2-Low.", "3+")["violations"] == [gr.MSG_NON_POSITIVE]
    assert checked(spark, "T-DXd works.", "0")["violations"] == [gr.MSG_THERAPY]
    assert checked(spark, "T-DXd works per DESTINY-Breast06.", "0").is_grounded
    assert checked(spark, "Kadcyla, always.")["flagged"] == ["always"] and checked(spark, "Pertuzumab").is_grounded


def test_substring_join_matches_brute_force(spark):
    texts = [(str(n), s) for n, s in enumerate(["HER2 low case", "abcabc", "xx", "", "The quick brown fox jumps", "quick brown  fox", "ISH"])]
    needles = ["her2", "c", "BC", "abca", "he quick brown fo", "quick brown fox", "zzz", "fox", "ish", "brown  fox", "x", "ow c", " ", "  ", "k b"]
    t_df = spark.createDataFrame(texts, "text_id string, text string")
    n_df = spark.createDataFrame([(s,) for s in needles], "needle string")
    expected = sorted((i, n) for i, s in texts for n in needles if n.lower() in s.lower())
    assert sorted(map(tuple, substring_join.contains_pairs(t_df, n_df).select("text_id", "needle").collect())) == expected
    top = substring_join.top_matches(t_df, n_df.unionByName(spark.createDataFrame([("",)], "needle string")), [], 2)
    assert top.filter("needle = ''").count() == 2


def test_vector_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(data)], "id bigint, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{n}", x.tolist()) for n, x in enumerate(asked)], "query_id string, embedding array<double>")
    sims = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (data / np.linalg.norm(data, axis=1)[:, None]).T
    expected = {f"q{n}": np.argsort(-row)[:4].tolist() for n, row in enumerate(sims)}
    for limit in (vec.QUERY_BYTES, 130):  # one block, several blocks
        out = {}
        for x in vec.top_k(df, q, 4, limit).orderBy("query_id", "rank").collect():
            out.setdefault(x["query_id"], []).append(x["id"])
        assert out == expected


def test_embedding_is_idempotent(spark):
    texts = spark.createDataFrame([(str(n), f"text {n}") for n in range(120)], "id string, text string")
    first = vec.embed_missing(texts, texts.select("id").limit(0)).cache()
    assert first.count() == 120 and vec.embed_missing(texts, first).count() == 0
    assert vec.wrong_dimension(first, 64).count() == 0


def test_static_evidence(spark):
    rows = spark.createDataFrame([("HER2-Low",), ("HER2_Null",), ("Nope",)], "category string")
    out = {x["category"]: x for x in t.static_evidence(rows, v.evidence_df(spark), v.evidence_guidelines_df(spark)).collect()}
    assert out["HER2-Low"]["eligible_agents"] == "T-DXd" and out["HER2_Null"]["eligible_agents"] == "" and not out["Nope"]["found"]


def test_retrieval_orders_and_limits(spark):
    nodes = spark.createDataFrame([("T", "e", "Entity"), ("T", "x", "X"), ("T", "y", "Y"), ("T", "lonely", "L")], "type string, id string, label string")
    edges = spark.createDataFrame([("e", "p", "x", 0.2), ("e", "p", "y", 0.9)], "src string, predicate string, dst string, confidence double")
    chunks = spark.createDataFrame([(f"c{n}", f"text {n}", "doc") for n in range(5)], "chunk_id string, content string, source_doc string")
    said = spark.createDataFrame([(f"c{n}", "e") for n in range(5)] + [("c0", "lonely")], "chunk_id string, entity_id string")
    asked = spark.createDataFrame([(1, "e"), (1, "lonely"), (1, "none")], "request_id int, entity_id string")
    out = t.retrieve(asked, said, chunks, nodes, edges, 4).orderBy("rank").collect()
    assert [(x["entity_id"], x["related_id"], x["chunk_id"]) for x in out] == [("lonely", None, "c0"), ("e", "y", "c0"), ("e", "y", "c1"), ("e", "y", "c2")]


def _shuffled(spark, run):
    """Rows shuffled while ``run`` runs, and what it returns."""
    def written():
        double, none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, double, none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(n) for n in range(stages.size()))}
    before = written()
    out = run()
    return sum(rows for key, rows in written().items() if key not in before), out


def test_retrieval_by_labels_works_once_per_set_of_needles(spark):
    nodes = spark.createDataFrame([("T", f"e{n}", f"red {n}") for n in range(10)] + [("T", "x", "X"), ("T", "y", "Y")], "type string, id string, label string")
    edges = spark.createDataFrame([(f"e{n}", f"p{k:02}", "xy"[k % 2], None if k == 7 else k / 20) for n in range(10) for k in range(18)],
                                  "src string, predicate string, dst string, confidence double")
    chunks = spark.createDataFrame([(f"c{n:02}", f"text {n}", "doc") for n in range(18)], "chunk_id string, content string, source_doc string")
    said = spark.createDataFrame([(f"c{n:02}", f"e{k}") for n in range(18) for k in range(10)], "chunk_id string, entity_id string")
    asked = spark.createDataFrame([(r, w) for r in range(200) for w in ("red", "RED", "blue")] + [(200, "x"), (201, None)], "request_id int, needle string")
    rows, out = _shuffled(spark, lambda: t.retrieve_by_labels(asked, said, chunks, nodes, edges, 20).collect())
    best = sorted([(-2.0 if k == 7 else -k / 20, f"e{n}", f"c{c:02}") for n in range(10) for k in range(18) for c in range(18)])[:20]
    for r in (0, 199):
        got = sorted((x["rank"], x["entity_id"], x["chunk_id"]) for x in out if x["request_id"] == r)
        assert got == [(k + 1, e, c) for k, (_, e, c) in enumerate(best)]
    assert len(out) == 200 * 20 and rows < 2_000


def test_context_places_pairs_without_sorting_them(spark):
    """Repeated keys on every side, entities without edges or mentions; entities beyond the limit never meet their pairs."""
    nodes = [("T", f"e{n}", f"Label {n % 3}") for n in range(8)] + [("U", "e1", "other"), ("T", "e1", "again"), ("T", "x", "X"), ("T", "x", "X2"), ("T", "y", None)]
    edges = [(f"e{n}", f"p{k % 3}", "xyz"[k % 3], k / 10) for n in range(1, 8) for k in range(9)]
    chunks = [(f"c{n:02}", f"text {n}", "doc") for n in range(16)] + [("c03", "text 3 again", "doc"), ("c01", "text 1", "doc")]
    said = [(f"c{n:02}", f"e{k}") for n in range(17) for k in range(2, 8)] + [("c99", "e1")]
    asked = [(r, [f"e{(r * k) % 8}" for k in range(1, 4)], ["LABEL 1"]) for r in range(60)]
    frames = [spark.createDataFrame(nodes, "type string, id string, label string"), spark.createDataFrame(edges, "src string, predicate string, dst string, confidence double"),
              spark.createDataFrame(said, "chunk_id string, entity_id string"), spark.createDataFrame(chunks, "chunk_id string, content string, source_doc string")]
    requests = spark.createDataFrame(asked, "request_id int, entity_ids array<string>, labels array<string>")
    shuffled, out = _shuffled(spark, lambda: t.context_rows(requests, *frames).collect())
    key = lambda x: (x[0], x[2], x[3] or "", x[4] or "", x[7] or "")
    for r, ids, _ in asked:
        rows = set()
        for kind, node, label in nodes:
            if node in ids or (label or "").lower() == "label 1":
                mine = [(p, d, lab, c) for src, p, d, c in edges if src == node for _, other, lab in nodes if other == d] or [(None,) * 4]
                texts = [c for c in chunks for m in said if m == (c[0], node)] or [(None,) * 3]
                rows |= {(node, label, kind, p, d, lab, c, *text) for p, d, lab, c in mine for text in texts}
        want = sorted(map(key, rows))[:50]
        got = sorted((x["rank"], x) for x in out if x["request_id"] == r)
        assert [n for n, _ in got] == list(range(1, len(want) + 1)) and [key(tuple(x)[1:]) for _, x in got] == want
        assert {tuple(x)[1:11] for _, x in got} <= rows and len({tuple(x) for _, x in got}) == len(got)
    folded = {x["request_id"]: x for x in t.fold_context(t.context(requests, *frames)).collect()}
    for r, _, _ in asked:
        mine = [x for x in out if x["request_id"] == r]
        assert {e["entity_id"] for e in folded[r]["entities"]} == {x["entity_id"] for x in mine}
        assert {c["context"] for c in folded[r]["chunks"]} == {x["context"] for x in mine} - {None}
        assert {(e["from_label"], e["relation"], e["to_label"]) for e in folded[r]["relations"]} == {
            (x["label"], x["relation"], x["related_entity"]) for x in mine if x["relation"] and x["related_entity"]}
    assert shuffled < 2_500, shuffled


def test_long_needles_are_not_handed_on_with_each_of_their_words(spark):
    """Where joins shuffle, bytes stay far below needles times their words; citations are cut before texts join them."""
    words = lambda n: " ".join(f"w{(n + 1) * (k + 3) * 7919 % 401}" for k in range(240))
    texts = spark.createDataFrame([(f"c{n:03}", words(n), f"s{n % 7}", "evidence") for n in range(60)], "chunk_id string, content string, source_doc string, content_type string")
    asked = texts.select(F.substring("chunk_id", 2, 3).cast("int").alias("query_id"), F.substring("content", 5, 900).alias("query"))

    def written():
        double, none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, double, none)
        return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        out = t.citations(t.evidence(asked, texts, first=t.CITATIONS)).collect()
        size = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sorted((x["query_id"], x["rank"], x["text"]) for x in out) == [(n, 1, words(n)[:150]) for n in range(60)]
    assert size < 1_900_000


def test_bucketed_rows_come_in_bounded_batches():
    class Rows:
        schema = {"id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})}

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run
    rows = pd.DataFrame({"id": range(4096), "embedding": list(np.random.default_rng(2).standard_normal((4096, 64)).astype(np.float32))})
    for probes in (1, 24):
        frames = list(vec._bucketed(Rows(), "id", 6, 16, probes, 5)([rows]))
        assert max(map(len, frames)) <= 8192 and sum(map(len, frames)) == 4096 * 6 * probes


def test_raw_extractions_are_dealt_by_their_number(spark, tmp_path):
    spark.range(2_200_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = inputs.raw_extractions(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 44 and rows.count() == 2_200_000


def test_triples_and_jsonld(spark, tmp_path):
    n, e = v.seed_entities_df(spark), v.seed_relations_df(spark)
    rows = rdf.triples(n, e).cache()
    kinds = {x["predicate"].split("#")[1]: x["datatype"] for x in rows.filter("subject like '%Group1' and object_kind = 'literal'").collect()}
    assert kinds["group_number"] == "integer" and kinds["ratio_threshold"] == "decimal" and kinds["label"] == "string"
    assert rows.filter("subject like '%HER2_Low' and predicate like '%subClassOf'").count() == 1
    assert rows.filter("predicate like '%sameAs'").count() == sum(1 for s in v.SEED_ENTITIES if s[3])
    sinks.write_ntriples(rows, str(tmp_path / "nt"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "nt")).collect()]
    assert len(lines) == rows.count() and all(s.startswith("<") and s.endswith(" .") for s in lines)
    seen = [json.loads(x["value"]) for x in rdf.jsonld(rows).collect()]
    assert len(seen) == rows.count() and all(len(node) == 2 and "@id" in node for node in seen)


def test_answer_texts(spark):
    n, e = v.seed_entities_df(spark), v.seed_relations_df(spark)
    cases = spark.createDataFrame([(1, "1+", None, 1.0, 3.0, None, "HER2_Null")], "case_id bigint, ihc_score string, ish_group string, ish_ratio double, signals_per_cell double, fractal_d0 double, category string")
    q = spark.createDataFrame([(7, "T-DXd", True, json.dumps(r.AGENTS), [], 0, 1)], "query_id bigint, query string, has_case boolean, router_raw string, ran array<string>, iteration int, case_id bigint")
    chunks = spark.createDataFrame([("c", "T-DXd works", "d", "evidence")], "chunk_id string, content string, source_doc string, content_type string")
    row = answer.answer(q, cases, n, e, chunks).first()
    assert row["agents_invoked"] == ",".join(r.AGENTS)
    for part in ("class: HER2_Low", "graph path ends at: HER2_", "- [d] T-DXd works", ": eligible for ", ": not eligible for ", "status: "):
        assert part in row["answer"], (part, row["answer"])
    assert answer.answer(q, cases, n, e, chunks, max_passes=3).first()["agents_invoked"] == ",".join(r.AGENTS[:3])


def test_ingest_keeps_all_streams(spark, tmp_path):
    def feed(name, rows, folder):
        spark.createDataFrame(rows, "chunk_id string, content string").write.parquet(str(tmp_path / name))
        src = spark.readStream.schema("chunk_id string, content string").parquet(str(tmp_path / name))
        ingest.ingest(src, lambda df: df, str(tmp_path / folder), str(tmp_path / f"cp-{name}"))
    feed("a", [("a1", "1"), ("a2", "1"), ("x", "1")], "in")
    feed("b", [("b1", "1"), ("x", "2")], "in")
    first = {("a1", "1"), ("a2", "1"), ("b1", "1"), ("x", "2")}
    assert {(r.chunk_id, r.content) for r in ingest.ingested(spark, str(tmp_path / "in")).collect()} == first
    ingest.fold(spark, str(tmp_path / "in"), str(tmp_path / "next"))
    feed("c", [("c1", "1"), ("a1", "3")], "next")
    assert {(r.chunk_id, r.content) for r in ingest.ingested(spark, str(tmp_path / "next")).collect()} == first - {("a1", "1")} | {("c1", "1"), ("a1", "3")}


def test_streams(spark, tmp_path):
    schema = "thread_id string, seq bigint, agent string"
    folder = tmp_path / "in"
    for rows in [[("t", 5, "b"), ("t", 4, "a"), ("t", 3, "b"), ("u", 1, "a")], [("t", 9, "a"), ("t", 8, "c")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        src = spark.readStream.schema(schema).parquet(str(folder))
        threads.run_threads(src, str(tmp_path / "kept/out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "kept/out"))
    mine = {x["seq"]: (x["item_no"], x["first_run"]) for x in out.filter("thread_id = 't'").collect()}
    assert mine == {3: (1, True), 4: (2, True), 5: (3, False), 8: (4, True), 9: (5, False)}
    folded = threads.fold_threads(out.select("thread_id", "seq", "agent")).filter("thread_id = 't'").first()
    assert folded["ran"] == ["b", "a", "c"] and folded["items"] == 5


def test_retrieval_passes_over_missing_ends(spark):
    nodes = spark.createDataFrame([("T", "e", "Entity"), ("T", "z", "Z"), ("T", "y", "Y")], "type string, id string, label string")
    gone = [("e", "p", f"gone{n}", 0.99) for n in range(30)] + [("e", "a", "y", 0.5)] * 60
    edges = spark.createDataFrame(gone + [("e", "q", "z", 0.1)], "src string, predicate string, dst string, confidence double")
    chunks = spark.createDataFrame([("zz", "text", "doc")], "chunk_id string, content string, source_doc string")
    said = spark.createDataFrame([(f"gone{n}", "e") for n in range(25)] + [("zz", "e")], "chunk_id string, entity_id string")
    asked = spark.createDataFrame([(1, "e")], "request_id int, entity_id string")
    out = t.retrieve(asked, said, chunks, nodes, edges, 20).collect()
    assert len(out) == 20 and {(x["related_id"], x["chunk_id"]) for x in out} == {("y", "zz")}
    asked = spark.createDataFrame([(1, ["e"], [])], "request_id int, entity_ids array<string>, labels array<string>")
    out = t.context_rows(asked, nodes, edges, said, chunks).collect()
    assert [(x["related_id"], x["chunk_id"]) for x in sorted(out, key=lambda x: x["rank"])] == [("y", "zz"), ("z", "zz")]


def test_build_is_repeatable(spark, tmp_path):
    text = "The IHC 3+ score implies HER2-Positive by the guideline. Trastuzumab Deruxtecan is a treatment for HER2-Low in the trial."
    docs = spark.createDataFrame([("a.md", text + "\n")], "source_doc string, text string")
    run = lambda day: sinks.RunTables(spark, str(tmp_path / "kg"), datetime(2026, 1, day))
    first = bld.build(run(1), docs, None, "2026-01-01")
    ids = sorted(map(tuple, first["nodes"].select("type", "id").collect()))
    assert first["report"].first()["is_consistent"] and first["mentions"].count() >= 3 and first["new_vectors"].count() > 30
    again = bld.build(run(2), docs, None, "2026-01-01")
    assert sorted(map(tuple, again["nodes"].select("type", "id").collect())) == ids
    assert again["triples"].count() == first["triples"].count() and again["new_vectors"].count() == 0
    assert spark.read.text(run(2).path("ntriples")).count() == spark.read.text(run(2).path("jsonld")).count() == again["triples"].count()
    assert spark.read.json(run(2).path("record")).first()["passed"] >= 12


def test_build_takes_whole_rows(spark):
    ent = "chunk_id string, pos int, label string, type string, id string, definition string, source_quote string, ncit_uri string, snomed_uri string, confidence double, resolved_uri string"
    entities = spark.createDataFrame([("c1", 0, "X", "Assay", "X", "zzz def", "q1", None, None, 0.9, "u"), ("c2", 0, "X", "Assay", "X", "aaa def", "q2", None, None, 0.7, "u")], ent)
    relations = spark.createDataFrame([("c1", 0, "X", "implies", "X", 0.9, "zzz"), ("c2", 0, "X", "implies", "X", 0.2, "aaa")],
                                      "chunk_id string, pos int, subject_id string, predicate string, object_id string, confidence double, evidence string")
    chunks = spark.createDataFrame([], "chunk_id string, source_doc string, section string, content string, content_type string")
    nodes, edges = bld.graph_tables(chunks, entities, relations, "2026")
    props = nodes.filter("id = 'X'").first()["props"]
    assert (props["definition"], props["source_doc"], props["confidence"]) == ('"aaa def"', '"c2"', "0.7")
    edge = edges.filter("src = 'X'").first()
    assert (edge["confidence"], edge["props"]["evidence"], edge["props"]["source_chunk"]) == (0.2, '"aaa"', '"c2"')


def test_triples_are_a_set_without_comparing_them_all(spark, tmp_path):
    props = "map<string,string>"
    n = spark.createDataFrame([("T", x, lab, {"k": '"1"'}) for x, lab in [("a b", "A"), ("a_b", "A"), ("a", None), ("b_c", "L"), ("c", "L"), ("U", "x"), ("U", "x")]] + [("V", "c", "L", {})],
                              f"type string, id string, label string, props {props}")
    e = [("a", "b", "c", 0.5), ("a", "b", "c", 0.25), ("a", "b", "c", None), ("a", "b_c", "c", 0.5), ("a_b", "c", "c", 0.5), ("a b", "c", "c", 0.5), ("a", "x", "b_c", None),
         ("a", "SUPERSEDED_BY", "c", 0.5), ("a", "supersededBy", "c", None), ("c", "proposedEquivalence", "a", 1.0), ("c", "proposedCorrelation", "a", 1.0),
         ("a", "refinesCategory", "c", None), ("a", "b_c", "gone", 0.5), ("a_b", "b_c", "c", None), ("a", "b_b_c", "c", 0.5)]
    e = spark.createDataFrame([(s, p, d, None, None, c, False, {}) for s, p, d, c in e],
                              f"src string, predicate string, dst string, condition string, algorithm_id string, confidence double, is_hypothesis boolean, props {props}")
    for base in (rdf.NS["her2"], rdf.NS["owl"], "plain"):
        want = rdf.declarations(spark, base).unionByName(rdf.node_rows(n, base).drop("id")).unionByName(rdf.edge_rows(e, n, base).drop("id"))
        got = sorted(map(str, rdf.triples(n, e, base).collect()))
        assert got == sorted(set(map(str, want.collect())))
    rows = rdf.triples(n, e)
    assert rows._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    sinks.write_ntriples(rows, str(tmp_path / "nt"))
    sinks.write_jsonld(rows, str(tmp_path / "ld"))
    for folder in ("nt", "ld"):
        assert spark.read.text(str(tmp_path / folder)).count() == len(rows.collect())
        assert {x.name.rsplit(".", 2)[-1] for x in (tmp_path / folder).glob("part-*")} == {"gz"}


def test_vector_search_makes_few_scores_at_once():
    rng = np.random.default_rng(3)
    data, asked = rng.integers(-2, 3, (5000, 4)).astype(np.float32), rng.integers(-2, 3, (4000, 4)).astype(float)  # many equal scores
    names = pa.array([f"v{n:05d}" for n in range(len(data))])
    batches = [pa.RecordBatch.from_arrays([names[at:at + 2500], pa.array(list(data[at:at + 2500]))], ["id", "embedding"]) for at in (0, 2500)]
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
    fields = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])
    tracemalloc.start()
    found = pa.Table.from_batches(vec._best([f"q{n}" for n in range(len(asked))], asked, 3, batches, fields)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores of a batch are 80 MB
    unit = data / np.maximum(np.linalg.norm(data.astype(float), axis=1, keepdims=True), 1e-300)
    want = np.argsort(-np.round(asked[:50] @ unit.T, 12), axis=1, kind="stable")[:, :3]
    got = found.groupby("query_id")["id"].apply(list)
    assert len(found) == 12000 and all(got[f"q{n}"] == [f"v{x:05d}" for x in row] for n, row in enumerate(want))


def test_jsonld_has_one_object_per_subject(spark, tmp_path):
    rows = [("urn:a", "urn:p", f"urn:o{n}", "uri", None) for n in range(300)]
    rows += [("urn:a", "urn:q", text, "literal", "string") for text in ('x"]}\n', "back\\slash]}", "", "tab\there", "é")]
    rows += [("urn:a", "urn:n", "5", "literal", "integer"), ("urn:b", "urn:p", "urn:a", "uri", None), ("urn:b]}", "urn:p", "urn:a", "uri", None), (None, "urn:p", "urn:a", "uri", None)]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, object_kind string, datatype string").repartition(5)
    sinks.write_jsonld(df, str(tmp_path / "ld"))
    seen = [json.loads(x["value"]) for x in sinks.read_jsonld(spark, str(tmp_path / "ld")).collect()]
    assert sorted(str(node["@id"]) for node in seen) == ["None", "urn:a", "urn:b", "urn:b]}"]
    back = [(node["@id"], p, v.get("@value", v.get("@id")), v.get("@type", "").split("#")[-1]) for node in seen for p, values in node.items() if p != "@id" for v in values]
    assert sorted(map(str, back)) == sorted(str((s, p, o, "integer" if t == "integer" else "")) for s, p, o, _, t in rows)
    whole = "".join(x["value"] + "\n" for x in spark.read.text(str(tmp_path / "ld")).coalesce(1).collect())
    first, end = json.JSONDecoder().raw_decode(whole)  # objects one after another, as they stand in the files
    assert first in seen and whole[end] == "\n"
