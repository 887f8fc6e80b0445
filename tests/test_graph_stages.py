"""Resolution, graph build, decision tables, rules, paths."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from oncolattice.functions.prefix import running_start
from oncolattice.functions.similarity import matched, sequence_match
from oncolattice.operators import algorithms as a, graph as g, paths as p, resolution as r, rules
from oncolattice.sources import vocabulary as v

ENT = "chunk_id string, pos int, local_id string, label string, type string, definition string, source_quote string, candidate_uri string, confidence double"


def entities(spark, rows):
    return spark.createDataFrame([("c", n, f"e{n}", lab, "Assay", d, None, uri, conf) for n, (lab, d, uri, conf) in enumerate(rows)], ENT)


def test_resolution_table(spark):
    rows = [("HER2-Positive", None, None, 1.0), ("IHC 2+", None, None, 1.0), ("T-DXd", None, None, 1.0), ("Some Entity", None, "NCIt:C99999", 1.0),
            ("Completely Unknown Entity XYZ123", None, None, 1.0), ("CAP-2025", None, None, 1.0)]
    out = [x["resolved_uri"] for x in r.resolve(entities(spark, rows)).orderBy("pos").collect()]
    assert out[:4] == ["NCIt:C68748", "NCIt:C173789", "NCIt:C155379", "NCIt:C99999"]
    assert out[4].startswith("her2:") and out[5] == "her2:CAP_Biomarker_2025"


def test_seed_labels_mostly_resolve(spark):
    rows = [(label, None, None, 1.0) for _, label, *_ in v.SEED_ENTITIES]
    local = r.resolve(entities(spark, rows)).filter("resolved_uri like 'her2:%' and ncit_uri is null").count()
    assert local <= 15


def test_fuzzy_matches_brute_force(spark):
    labels = ["HER2 positve", "Perzutumab", "ISH grup 3", "lacunarity", "Trastuzumab Deruxtecan-x", "zzz", "", "Score 3 Plus", "multifractal-spread", "FISHH"]
    rows = {x["label"]: x["fuzzy_uri"] for x in r.fuzzy_match(entities(spark, [(s, None, None, 1.0) for s in labels]), F.col("label"), list(v.CANONICAL_URIS.items())).collect()}

    def brute(s):
        for form in (s, "_".join(s.replace("-", " ").split()) if s else s):
            hit = get_close_matches(form, list(v.CANONICAL_URIS), n=1, cutoff=0.75)
            if hit:
                return v.CANONICAL_URIS[hit[0]]
        return None
    assert rows == {s: brute(s) for s in labels}


@given(st.text("abcd -", max_size=14), st.text("abcd -", max_size=14))
def test_matching_blocks(a, b):
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    assert matched(a, b) == sum(x.size for x in blocks)


def test_fuzzy_candidates_miss_nothing(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)})
    table = spark.createDataFrame([(k, k) for k in known], "label string, uri string")
    rows = spark.createDataFrame([(a,) for a in asked], "label string")
    got = {x["label"]: x["uri"] for x in sequence_match(rows, table, 0.75).collect()}
    assert got == {a: m[0] for a in asked if (m := get_close_matches(a, known, n=1, cutoff=0.75))}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    best = {a: max(((1 - distance(a, k) / max(len(a), len(k)), k) for k in known)) for a in asked}
    got = {x["label"]: x["fuzzy_uri"] for x in r.levenshtein_match(rows, table).collect()}
    assert got == {a: k for a, (score, k) in best.items() if score >= 0.75}


def test_dedupe_merges_later_definitions(spark):
    rows = [("T-DXd", "early", None, 0.5), ("T-DXd", "best", None, 0.9), ("T-DXd", "best", None, 0.9), ("T-DXd", "more", None, 0.2), ("T-DXd", "more", None, 0.1), ("IHC", None, None, 0.5), ("IHC", "x", None, 0.4)]
    out = {x["resolved_uri"]: x for x in r.dedupe(r.resolve(entities(spark, rows))).collect()}
    assert out["NCIt:C155379"]["definition"] == "best | more | more" and out["NCIt:C155379"]["confidence"] == 0.9
    assert out["NCIt:C17089"]["definition"] is None and out["NCIt:C155379"]["id"] == "TrastuzumabDeruxtecan"


def test_relations_follow_the_winner(spark):
    rows = [("T-DXd", None, None, 0.5), ("IHC", None, None, 0.5)]
    rel = spark.createDataFrame([("c", "e0", "implies", "e1", 1.0), ("c", "e9", "implies", "e0", 1.0)], "chunk_id string, subject_id string, predicate string, object_id string, confidence double")
    out = {(x["subject_id"], x["object_id"]) for x in r.rewrite_relations(rel, r.resolve(entities(spark, rows))).collect()}
    assert out == {("TrastuzumabDeruxtecan", "IHC"), ("e9", "TrastuzumabDeruxtecan")}


def seed(spark):
    return v.seed_entities_df(spark), v.seed_relations_df(spark)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_seed_twice_is_the_same(spark):
    n, e = seed(spark)
    assert (n.count(), e.count(), n.filter("type = 'IHCScore'").count()) == (34, 29, 5)
    once = g.upsert_nodes(n.limit(0), n.withColumn("seq", F.lit(1)))
    twice = g.upsert_nodes(once, n.withColumn("seq", F.lit(1)))
    assert rows_of(once) == rows_of(twice) and twice.count() == 34
    e1 = g.upsert_edges(e.limit(0), e.withColumn("seq", F.lit(1)), n)
    assert rows_of(e1) == rows_of(g.upsert_edges(e1, e.withColumn("seq", F.lit(1)), n)) and e1.count() == 29


def test_upsert_policies(spark):
    schema = "type string, id string, label string, props map<string,string>"
    old = spark.createDataFrame([("T", "1", "a", {"x": "1", "y": '"k"'}), ("T", "2", None, {})], schema)
    new = spark.createDataFrame([("T", "1", None, {"x": None, "y": '""', "z": "true"}, 1), ("T", "1", "b", {"z": "false"}, 2), ("U", "1", "c", None, 1)], schema + ", seq bigint")
    out = {(x["type"], x["id"]): x for x in g.upsert_nodes(old, new).collect()}
    assert out["T", "1"]["props"] == {"y": '""', "z": "false"} and out["T", "1"]["label"] == "b"
    assert out["T", "2"]["props"] == {} and out["U", "1"]["props"] == {}
    keep = {(x["type"], x["id"]): x for x in g.upsert_nodes(old, new, "keep_non_empty").collect()}
    assert keep["T", "1"]["props"] == {"x": "1", "y": '"k"', "z": "false"}


def test_decision_table_counts(spark):
    nodes, explicit = v.decision_nodes_df(spark), v.explicit_edges_df(spark)
    out = {x["algorithm_id"]: (x["nodes"], x["edges"], x["distinct_edges"]) for x in a.totals(nodes, a.emitted_edges(nodes, explicit)).collect()}
    assert out == {v.IHC_ALGORITHM: (6, 19, 10), v.ISH_ALGORITHM: (14, 12, 12), v.RAKHA_ALGORITHM: (7, 13, 13)}
    merged = a.merged_edges(a.emitted_edges(nodes, explicit))
    assert a.unknown_ends(merged, nodes.select("id").unionByName(v.seed_entities_df(spark).select("id"))).count() == 0
    with pytest.raises(ValueError):
        a.listing(nodes, "nope")


def test_rules_hold_on_seed(spark):
    out = rules.run(*seed(spark))
    assert out.filter("valid").count() == 13
    assert rules.report(out).first().asDict() == {"total": 13, "passed": 13, "failed": 0, "critical": 0, "is_consistent": True}


@pytest.mark.parametrize("rule,drop", [
    ("IHC3Plus_implies_Positive", "src = 'Score3Plus' and predicate = 'implies'"), ("IHC2Plus_requires_ISH", "predicate = 'requiresReflexTest'"),
    ("HER2Null_not_eligible_TDXd", "src = 'HER2_Null' and predicate = 'notEligibleFor'"), ("No_orphan_entities", "src = 'Group2'")])
def test_rule_fails_alone(spark, rule, drop):
    n, e = seed(spark)
    failed = [x["rule_id"] for x in rules.run(n, e.filter(f"not ({drop})")).filter("not valid").collect()]
    assert failed == [rule]


def test_hypothesis_rule(spark):
    n, e = seed(spark)
    bad = e.limit(1).select(F.lit("Lacunarity").alias("src"), F.lit("proposedEquivalence").alias("predicate"), F.lit("HER2_Low").alias("dst"), "condition", "algorithm_id",
                            "confidence", F.lit(None).cast("boolean").alias("is_hypothesis"), "props")
    assert [x["rule_id"] for x in rules.run(n, e.unionByName(bad)).filter("not valid").collect()] == ["Fractal_marked_as_hypothesis"]


def decision_graph(spark):
    n, e = seed(spark)
    nodes = v.decision_nodes_df(spark)
    steps = a.graph_edges(a.merged_edges(a.emitted_edges(nodes, v.explicit_edges_df(spark))))
    return n.unionByName(a.graph_nodes(nodes)), e.unionByName(steps), nodes


def test_seed_paths(spark):
    n, e, nodes = decision_graph(spark)
    best = {x["start"]: x["end"] for x in p.score_paths(n, e).filter("rank = 1").collect()}
    assert best == {"Score3Plus": "HER2_Positive", "Score2Plus": "HER2_Equivocal", "Score1Plus": "HER2_Negative", "Score0Plus": "HER2_Negative", "Score0": "HER2_Null"}
    assert p.ish_paths(n, e).count() == 0
    entries = {x["start"] for x in p.algorithm_paths(nodes, e).collect()}
    assert entries == {"IHC_ENTRY"}
    reached = {x["id"] for x in p.reachable(nodes.filter("id = 'RAKHA_ENTRY'").select("id"), e).collect()}
    assert "Score0" in reached and "RAKHA_NODE4" in reached and len(reached) == 11


def test_paths_use_an_edge_once(spark):
    edges = [("a", "b", 1), ("b", "a", 1), ("b", "t", 1), ("a", "b", 2)]
    e = spark.createDataFrame([(s, "leadsTo", d, str(k), None) for s, d, k in edges], "src string, predicate string, dst string, condition string, algorithm_id string")
    n = spark.createDataFrame([("a",)], "id string")

    def brute(node, used, path, out):
        for i, (s, d, _) in enumerate(edges):
            if s == node and i not in used and len(path) <= 5:
                out.append(path + [d])
                brute(d, used | {i}, path + [d], out)
        return out
    found = sorted(x["nodes"] for x in p.enumerate_paths(n, e, 5).collect())
    assert found == sorted(brute("a", frozenset(), ["a"], []))
    ends = p.enumerate_paths(n, e, 5, spark.createDataFrame([("t",)], "id string"))
    assert sorted(x["nodes"] for x in ends.collect()) == sorted(q for q in found if q[-1] == "t")


def test_running_start(spark):
    rows = [("hot", i, i % 5) for i in range(1000)] + [("cold", i, 1) for i in range(3)]
    out = {(x["k"], x["o"]): x["s"] for x in running_start(spark.createDataFrame(rows, "k string, o int, n int"), "k", "o", "n", "s", span=64).collect()}
    total = 0
    for i in range(1000):
        assert out["hot", i] == total
        total += i % 5


def test_edge_corrections(spark):
    _, e = seed(spark)
    fix = spark.createDataFrame([("Group5", "implies", "HER2_Low", "HER2_Negative", 0.5, {"evidence": '"why"'})],
                                "src string, predicate string, old_dst string, new_dst string, confidence double, props map<string,string>")
    out = g.correct_edges(e, fix).filter("src = 'Group5'").collect()
    assert [(x["dst"], x["confidence"]) for x in out] == [("HER2_Negative", 0.5)]
    assert g.correct_edges(e, fix).count() == 29
