"""Registered queries: resolution, graph build, decision tables, paths, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algorithms as a, cases as c, graph as g, paths as p, resolution as r, rules
from ..functions.props import prop
from ..sources import vocabulary as v
from . import duck_inputs as d, inputs as i
from .registry import query, sql_list

# ---- vocabulary against data -------------------------------------------------


@query("SRC4", """SELECT n.type, n.id, n.label, count(*) AS specimens FROM specimen_edges e JOIN v_seed_nodes n ON e.dst = n.id GROUP BY ALL""",
       ("specimen_edges", "v_seed_nodes"))
def src4(spark, path):
    _, links = i.specimens(spark, path)
    per_end = links.groupBy("dst").agg(F.count("*").alias("specimens"))
    seed = v.seed_entities_df(spark).select("type", F.col("id"), "label")
    return per_end.join(F.broadcast(seed), F.col("dst") == F.col("id")).select("type", "id", "label", "specimens")


@query("SRC5", """SELECT s.predicate, s.dst, count(*) AS specimens FROM specimen_edges e JOIN v_seed_edges s ON e.dst = s.src WHERE e.predicate = 'classifiedAs' GROUP BY ALL""",
       ("specimen_edges", "v_seed_edges"))
def src5(spark, path):
    _, links = i.specimens(spark, path)
    per_end = links.filter(F.col("predicate") == "classifiedAs").groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("specimens"))
    return (per_end.join(F.broadcast(v.seed_relations_df(spark).select("src", "predicate", "dst")), "src")
            .groupBy("predicate", "dst").agg(F.sum("specimens").alias("specimens")))


@query("SRC6", """SELECT t.label, c.uri, s.snomed_uri, count(*) AS n FROM to_resolve t LEFT JOIN v_canonical c USING (label) LEFT JOIN v_snomed s USING (label) GROUP BY ALL""",
       ("to_resolve", "v_canonical", "v_snomed"))
def src6(spark, path):
    per_label = i.entities_to_resolve(spark, path).groupBy("label").agg(F.count("*").alias("n"))
    return (per_label.join(F.broadcast(v.canonical_df(spark).drop("ord")), "label", "left")
            .join(F.broadcast(v.snomed_df(spark)), "label", "left").select("label", "uri", "snomed_uri", "n"))


@query("SRC7", """SELECT h.parent, count(*) AS specimens FROM specimen_edges e JOIN v_hierarchy h ON e.dst = h.child GROUP BY 1""", ("specimen_edges", "v_hierarchy"))
def src7(spark, path):
    _, links = i.specimens(spark, path)
    per_end = links.groupBy(F.col("dst").alias("child")).agg(F.count("*").alias("n"))
    return per_end.join(F.broadcast(v.class_hierarchy_df(spark)), "child").groupBy("parent").agg(F.sum("n").alias("specimens"))


@query("SRC8", """SELECT d.id AS node_id, d.category, count(*) AS cases FROM classified c JOIN (SELECT * FROM (VALUES
 ('3+', 'IHC_NODE1', 'HER2_Positive'), ('2+', 'IHC_NODE2', 'HER2_Equivocal'), ('1+', 'IHC_NODE3', 'HER2_Low'), ('0+', 'IHC_NODE4', 'HER2_Ultralow'), ('0', 'IHC_NODE5', 'HER2_Null')) AS t(score, id, category)) d
 USING (score) GROUP BY ALL""", ("classified",))
def src8(spark, path):
    """Cases per node of the IHC table at which their score is decided."""
    n = v.decision_nodes_df(spark).filter(F.col("algorithm_id") == v.IHC_ALGORITHM)
    ends = n.select("id", F.coalesce("if_yes.result", "result").alias("score_id"), F.coalesce("if_yes.category", "category").alias("category")).filter("score_id is not null")
    per = c.classify(i.cases(spark, path)).withColumn("score_id", F.try_element_at(F.create_map(*[F.lit(x) for q in zip(c.SCORES, c.SCORE_IDS) for x in q]), F.col("score")))
    return (per.groupBy("score_id").agg(F.count("*").alias("cases")).join(F.broadcast(ends), "score_id")
            .select(F.col("id").alias("node_id"), "category", "cases"))


# ---- resolution --------------------------------------------------------------
def _to(spark, path):
    return i.entities_to_resolve(spark, path)


def _resolved(spark, path):
    return r.resolve(_to(spark, path), fuzzy="off")


def _pos():
    return F.col("pos").cast("bigint").alias("pos")


@query("RES1", "SELECT chunk_id, pos, trusted AS uri FROM res_tiers", ("res_tiers",))
def res1(spark, path):
    return _to(spark, path).select("chunk_id", _pos(), r.trusted_uri(F.col("candidate_uri")).alias("uri"))


@query("RES2", "SELECT chunk_id, pos, label, exact AS uri, exact_snomed AS snomed_uri FROM res_tiers", ("res_tiers",))
def res2(spark, path):
    return r.exact_match(_to(spark, path), v.canonical_df(spark), v.snomed_df(spark)).select(
        "chunk_id", _pos(), "label", F.col("exact_uri").alias("uri"), F.col("exact_snomed").alias("snomed_uri"))


_BLOCKS = r"""forms AS (SELECT DISTINCT unnest([label, norm]) AS label FROM (SELECT label, regexp_replace(trim(label), '[-\s]+', '_', 'g') AS norm FROM to_resolve)),p AS (SELECT f.label AS label, c.label AS known, len(c.label) AS la, len(f.label) AS lb FROM forms f, v_canonical c
  WHERE 2.0 * least(len(c.label), len(f.label)) >= 0.75 * (len(c.label) + len(f.label)) AND len(f.label) > 0),
run AS (SELECT label, known, i, j, (SELECT max(k) FROM range(1, least(la - i, lb - j) + 1) AS t(k) WHERE substr(known, i + 1, k) = substr(label, j + 1, k)) AS k
  FROM p, range(100) AS a(i), range(100) AS b(j) WHERE i < la AND j < lb AND substr(known, i + 1, 1) = substr(label, j + 1, 1)),
seg AS (SELECT label, known, 0 AS alo, la AS ahi, 0 AS blo, lb AS bhi, 0 AS n, 0 AS depth FROM p
  UNION ALL
  SELECT s.label, s.known, x.alo, x.ahi, x.blo, x.bhi, x.n, s.depth + 1 FROM (
    SELECT s.label, s.known, s.alo, s.ahi, s.blo, s.bhi, s.depth, max(struct_pack(n := least(r.k, s.ahi - r.i, s.bhi - r.j), i := -r.i, j := -r.j)) AS m
    FROM seg s JOIN run r ON r.label = s.label AND r.known = s.known AND r.i >= s.alo AND r.i < s.ahi AND r.j >= s.blo AND r.j < s.bhi
    GROUP BY ALL) s, LATERAL (SELECT unnest([struct_pack(alo := s.alo, ahi := -s.m.i, blo := s.blo, bhi := -s.m.j, n := s.m.n),
       struct_pack(alo := s.m.n - s.m.i, ahi := s.ahi, blo := s.m.n - s.m.j, bhi := s.bhi, n := 0)], recursive := true)) x),
score AS (SELECT p.label, p.known, 2.0::DOUBLE * coalesce(sum(n), 0) / any_value(la + lb) AS score FROM p JOIN seg USING (label, known) GROUP BY ALL),
best AS (SELECT label, known FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, known DESC) AS r FROM score WHERE score >= 0.75) WHERE r = 1)"""


@query("RES3", """SELECT t.label, coalesce(a.uri, b.uri) AS fuzzy_uri, count(*) AS n FROM to_resolve t
 LEFT JOIN (SELECT best.label, uri FROM best JOIN v_canonical c ON c.label = best.known) a ON a.label = t.label
 LEFT JOIN (SELECT best.label, uri FROM best JOIN v_canonical c ON c.label = best.known) b ON b.label = regexp_replace(trim(t.label), '[-\\s]+', '_', 'g') GROUP BY 1, 2""",
       ("to_resolve", "v_canonical"), _BLOCKS)
def res3(spark, path):
    """Labels with the dictionary entry most like them; the SQL finds matching blocks by recursion."""
    return r.fuzzy_match(_to(spark, path), F.col("label"), list(v.CANONICAL_URIS.items())).groupBy("label", "fuzzy_uri").agg(F.count("*").alias("n"))


@query("RES3_levenshtein", """SELECT label, uri AS fuzzy_uri, score FROM (SELECT l.label, c.uri, 1.0::DOUBLE - levenshtein(l.label, c.label) / greatest(len(l.label), len(c.label))::DOUBLE AS score,
 row_number() OVER (PARTITION BY l.label ORDER BY 1.0::DOUBLE - levenshtein(l.label, c.label) / greatest(len(l.label), len(c.label))::DOUBLE DESC, c.label DESC) AS rn
 FROM (SELECT DISTINCT label FROM to_resolve) l, v_canonical c WHERE 1.0::DOUBLE - levenshtein(l.label, c.label) / greatest(len(l.label), len(c.label))::DOUBLE >= 0.75) WHERE rn = 1""",
       ("to_resolve", "v_canonical"))
def res3_levenshtein(spark, path):
    return r.levenshtein_match(_to(spark, path), v.canonical_df(spark))


@query("RES4", "SELECT chunk_id, pos, ci AS uri FROM res_tiers", ("res_tiers",))
def res4(spark, path):
    return r.case_insensitive(_to(spark, path), v.canonical_df(spark)).select("chunk_id", _pos(), F.col("ci_uri").alias("uri"))


@query("RES5", "SELECT chunk_id, pos, fallback AS uri FROM res_tiers", ("res_tiers",))
def res5(spark, path):
    return _to(spark, path).select("chunk_id", _pos(), r.local_uri(F.col("label")).alias("uri"))


@query("RES6", "SELECT chunk_id, pos, norm FROM res_tiers", ("res_tiers",))
def res6(spark, path):
    return _to(spark, path).select("chunk_id", _pos(), r.normalize_label(F.col("label")).alias("norm"))


@query("RES7", "SELECT chunk_id, pos, nid AS id FROM res_tiers", ("res_tiers",))
def res7(spark, path):
    return _to(spark, path).select("chunk_id", _pos(), r.node_id(F.col("label")).alias("id"))


@query("RES8", "SELECT chunk_id, pos, id, uri_ AS resolved_uri, ncit_uri, snomed_uri FROM resolved", ("resolved",))
def res8(spark, path):
    return _resolved(spark, path).select("chunk_id", _pos(), "id", "resolved_uri", "ncit_uri", "snomed_uri")


@query("RES9", """SELECT chunk_id, resolved_uri, id, confidence, definition FROM res_fold f WHERE NOT EXISTS (SELECT 1 FROM res_rows n WHERE n.chunk_id = f.chunk_id AND n.uri_ = f.resolved_uri AND n.k = f.k + 1)""",
       ("res_winner", "resolved"), """
res_rows AS (SELECT s.chunk_id, s.uri_, s.definition, row_number() OVER (PARTITION BY s.chunk_id, s.uri_ ORDER BY s.pos) AS k FROM resolved s JOIN res_winner w ON s.chunk_id = w.chunk_id AND s.uri_ = w.uri_ WHERE s.pos > w.pos),
res_fold AS (SELECT chunk_id, uri_ AS resolved_uri, id, confidence, definition, 0 AS k FROM res_winner
 UNION ALL SELECT f.chunk_id, f.resolved_uri, f.id, f.confidence, CASE WHEN f.definition <> '' AND n.definition <> '' AND n.definition <> f.definition THEN f.definition || ' | ' || n.definition ELSE f.definition END, n.k
 FROM res_fold f JOIN res_rows n ON n.chunk_id = f.chunk_id AND n.uri_ = f.resolved_uri AND n.k = f.k + 1)""")
def res9(spark, path):
    return r.dedupe(_resolved(spark, path)).select("chunk_id", "resolved_uri", "id", "confidence", "definition")


@query("RES10", """SELECT r.chunk_id, coalesce(s.id, r.subject_id) AS subject_id, r.predicate, coalesce(o.id, r.object_id) AS object_id FROM local_relations r
 LEFT JOIN ids s ON s.chunk_id = r.chunk_id AND s.local_id = r.subject_id LEFT JOIN ids o ON o.chunk_id = r.chunk_id AND o.local_id = r.object_id""",
       ("res_winner", "resolved", "local_relations"),
       """ids AS (SELECT l.chunk_id, l.local_id, w.id FROM (SELECT chunk_id, local_id, arg_max(uri_, pos) AS uri_ FROM resolved GROUP BY 1, 2) l JOIN res_winner w USING (chunk_id, uri_))""")
def res10(spark, path):
    return r.rewrite_relations(i.local_relations(spark, path), _resolved(spark, path)).select("chunk_id", "subject_id", "predicate", "object_id")


@query("RES11", "SELECT count(*) AS unresolved FROM res_winner WHERE starts_with(uri_, 'her2:') AND ncit_uri IS NULL", ("res_winner",))
def res11(spark, path):
    return r.count_local(r.dedupe(_resolved(spark, path)))


# ---- graph build -------------------------------------------------------------
def _flat_nodes(df, *names):
    return df.select("type", "id", "label", *[prop(n).alias(n) for n in names])


def _incoming(spark, path):
    """Parts again under new labels, sizes removed on every third, plus every line item's quantity."""
    from ..functions.props import props_map
    part, li = i.read(spark, path, "part"), i.read(spark, path, "lineitem")
    k = F.col("p_partkey")
    first = part.select(F.lit("TherapeuticAgent").alias("type"), i._id("P", "p_partkey").alias("id"), F.when(k % 2 == 0, F.lit("renamed")).alias("label"),
                        F.create_map(F.lit("size"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("99")), F.lit("brand"), F.lit('""')).alias("props"), F.lit(0).cast("bigint").alias("seq"))
    second = li.select(F.lit("TherapeuticAgent").alias("type"), i._id("P", "l_partkey").alias("id"), F.lit(None).cast("string").alias("label"),
                       props_map(last_line=F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("props"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return first.unionByName(second)


_GRF1 = """SELECT n.type, n.id, CASE WHEN k % 2 = 0 THEN 'renamed' ELSE n.label END AS label, CASE WHEN k % 3 = 0 THEN NULL ELSE '99' END AS size, {brand} AS brand, l.last::VARCHAR AS last_line
 FROM (SELECT 'TherapeuticAgent' AS type, 'P' || p_partkey AS id, p_name AS label, p_partkey AS k, p_brand FROM part) n LEFT JOIN (SELECT l_partkey, max(l_orderkey * 100 + l_linenumber) AS last FROM lineitem GROUP BY 1) l ON l.l_partkey = n.k
 UNION ALL SELECT type, id, label, NULL, NULL, NULL FROM nodes WHERE type <> 'TherapeuticAgent'"""


@query("GRF1", _GRF1.format(brand="''"), ("nodes",))
def grf1(spark, path):
    return _flat_nodes(g.upsert_nodes(i.nodes(spark, path), _incoming(spark, path)), "size", "brand", "last_line")


@query("GRF1_keep", _GRF1.format(brand="p_brand").replace("CASE WHEN k % 3 = 0 THEN NULL ELSE '99' END", "CASE WHEN k % 3 = 0 THEN z ELSE '99' END").replace("p_brand FROM part) n", "p_brand, p_size::VARCHAR AS z FROM part) n"), ("nodes",))
def grf1_keep(spark, path):
    return _flat_nodes(g.upsert_nodes(i.nodes(spark, path), _incoming(spark, path), "keep_non_empty"), "size", "brand", "last_line")


@query("GRF2", "SELECT id, p_size::VARCHAR AS size, NULL::VARCHAR AS own_type FROM (SELECT 'P' || p_partkey AS id, p_size FROM part)")
def grf2(spark, path):
    n = i.nodes(spark, path).filter(F.col("type") == "TherapeuticAgent")
    mixed = F.map_concat("props", F.create_map(F.lit("type"), F.lit('"x"'), F.lit("gone"), F.lit(None).cast("string")))
    kept = g.node_props(mixed)
    return n.select("id", F.try_element_at(kept, F.lit("size")).alias("size"), F.try_element_at(kept, F.lit("type")).alias("own_type"))


@query("GRF3", "SELECT type, id, max(label) AS label FROM (SELECT type, id, label FROM clinical_nodes UNION SELECT type, id, label FROM v_seed_nodes) GROUP BY 1, 2", ("clinical_nodes", "v_seed_nodes"))
def grf3(spark, path):
    have, _ = i.clinical_graph(spark, path)
    return g.load_seed(have, v.seed_entities_df(spark, "2026-01-01T00:00:00")).select("type", "id", "label")


@query("GRF4", "SELECT id, label, coalesce(definition, '') AS definition, coalesce(ncit_uri, '') AS ncit_uri, chunk_id AS source_doc FROM resolved", ("resolved",))
def grf4(spark, path):
    return g.entity_nodes(_resolved(spark, path), "2026-01-01").select("id", "label", *[prop(n).alias(n) for n in ("definition", "ncit_uri", "source_doc")])


@query("GRF5", """SELECT src, predicate, dst, confidence FROM (SELECT 'S' || l_suppkey AS src, CASE WHEN l_returnflag = 'R' THEN 'notEligibleFor' ELSE 'eligibleFor' END AS predicate,
 'P' || l_partkey AS dst, arg_max(1 - l_discount, (l_orderkey * 100 + l_linenumber) * 1000 + round(l_discount * 100)::BIGINT) AS confidence FROM lineitem GROUP BY 1, 2, 3)
 UNION ALL SELECT src, predicate, dst, confidence FROM live_edges WHERE predicate NOT IN ('eligibleFor', 'notEligibleFor')""", ("live_edges",))
def grf5(spark, path):
    li = i.read(spark, path, "lineitem")
    new = li.select(i._id("S", "l_suppkey").alias("src"), F.when(F.col("l_returnflag") == "R", "notEligibleFor").otherwise("eligibleFor").alias("predicate"),
                    i._id("P", "l_partkey").alias("dst"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("algorithm_id"),
                    (1 - F.col("l_discount")).alias("confidence"), F.lit(False).alias("is_hypothesis"), F.create_map().cast("map<string,string>").alias("props"),
                    ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000 + F.round(F.col("l_discount") * 100).cast("bigint")).alias("seq"))
    return g.upsert_edges(i.edges(spark, path), new, i.nodes(spark, path)).select("src", "predicate", "dst", "confidence")


@query("GRF6", "SELECT src, predicate, dst, predicate = 'proposedEquivalence' OR is_hypothesis AS is_hypothesis FROM edges", ("edges",))
def grf6(spark, path):
    return g.force_hypothesis(i.edges(spark, path)).select("src", "predicate", "dst", "is_hypothesis")


@query("GRF7", "SELECT source_doc AS chunk_id, id AS entity_id FROM nodes WHERE type = 'TherapeuticAgent' AND source_doc IN (SELECT chunk_id FROM chunks)", ("nodes", "chunks"))
def grf7(spark, path):
    n = i.nodes(spark, path)
    ents = n.filter(F.col("type") == "TherapeuticAgent").select("id", prop("source_doc").alias("source_doc"))
    return g.mentions(ents, i.chunks(spark, path), n)


@query("GRF8", "SELECT chunk_id AS id, source_doc, content AS text, content_type FROM chunks", ("chunks",))
def grf8(spark, path):
    chunk = i.chunks(spark, path).withColumn("section", F.lit("s"))
    merged = g.upsert_nodes(i.nodes(spark, path).filter(F.col("type") == "Chunk"), g.chunk_nodes(chunk, "2026-01-01").withColumn("seq", F.lit(1)))
    return merged.select("id", *[prop(n).alias(n) for n in ("source_doc", "text", "content_type")])


@query("GRF9", "SELECT type, id, count(*) AS n FROM (SELECT 'TherapeuticAgent' AS type, 'P' || l_partkey AS id FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def grf9(spark, path):
    return g.duplicate_keys(i.read(spark, path, "lineitem").select(F.lit("TherapeuticAgent").alias("type"), i._id("P", "l_partkey").alias("id")))


@query("GRF10", "SELECT type, count(*) AS n FROM nodes GROUP BY 1", ("nodes",))
def grf10(spark, path):
    return g.node_counts(i.nodes(spark, path))


@query("GRF10_totals", "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_relations", ("nodes", "edges"))
def grf10_totals(spark, path):
    return g.graph_totals(i.nodes(spark, path), i.edges(spark, path))


@query("GRF11", "SELECT src, predicate, dst FROM edges WHERE NOT regexp_matches(src, '^[CN][0-9]') AND NOT regexp_matches(dst, '^N[0-9]') AND dst NOT IN (SELECT id FROM nodes WHERE type = 'Guideline')", ("edges", "nodes"))
def grf11(spark, path):
    _, left = g.detach_delete(i.nodes(spark, path), i.edges(spark, path), ["Guideline", "ISHGroup"])
    return left.select("src", "predicate", "dst")


@query("GRF12", """SELECT src, predicate, dst, confidence FROM edges WHERE NOT (predicate = 'refinesCategory' AND starts_with(src, 'N'))
 UNION ALL SELECT 'N' || n_nationkey, 'refinesCategory', 'R' || ((n_regionkey + 1) % 5), 1.0 FROM nation""", ("edges",))
def grf12(spark, path):
    n = i.read(spark, path, "nation")
    fix = n.select(i._id("N", "n_nationkey").alias("src"), F.lit("refinesCategory").alias("predicate"), i._id("R", "n_regionkey").alias("old_dst"),
                   F.concat(F.lit("R"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("new_dst"), F.lit(1.0).alias("confidence"),
                   F.create_map(F.lit("guideline_version"), F.lit('"ASCO_CAP_2023"')).alias("props"))
    return g.correct_edges(i.edges(spark, path), fix).select("src", "predicate", "dst", "confidence")


@query("GRF13", "SELECT entity_id, count(*) AS chunks FROM mention_pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ("mention_pairs",))
def grf13(spark, path):
    return g.mention_fan_in(i.mention_pairs(spark, path))


@query("GRF14", "SELECT count(*) AS n FROM nodes WHERE type <> 'Chunk' AND source_doc <> 'ontology:seed'", ("nodes",))
def grf14(spark, path):
    return g.extracted_count(i.nodes(spark, path))


@query("GRF15", """SELECT n.src, n.type, n.label, e.predicate, e.dst, e.dst_label FROM (SELECT id AS src, type, label FROM nodes WHERE type = 'TherapeuticAgent' ORDER BY id LIMIT 200) n
 LEFT JOIN (SELECT e.src, e.predicate, e.dst, m.label AS dst_label FROM edges e JOIN nodes m ON m.id = e.dst AND m.type <> 'Chunk') e ON e.src = n.src""", ("nodes", "edges"))
def grf15(spark, path):
    return g.neighbourhood(i.nodes(spark, path), i.edges(spark, path), 200, "TherapeuticAgent")


@query("GRF17", """SELECT src, predicate, dst, 'src' AS missing FROM edges WHERE src NOT IN (SELECT id FROM nodes)
 UNION ALL SELECT src, predicate, dst, 'dst' FROM edges WHERE dst NOT IN (SELECT id FROM nodes)""", ("edges", "nodes"))
def grf17(spark, path):
    return g.dangling_edges(i.edges(spark, path), i.nodes(spark, path)).select("src", "predicate", "dst", "missing")


@query("SRC10", "SELECT type, id, label FROM nodes WHERE type <> 'Chunk'", ("nodes",))
def src10(spark, path):
    return g.export_nodes(i.nodes(spark, path)).select("type", "id", "label")


@query("SRC11", "SELECT src, predicate, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE type <> 'Chunk') AND dst IN (SELECT id FROM nodes WHERE type <> 'Chunk')", ("edges", "nodes"))
def src11(spark, path):
    return g.export_edges(i.edges(spark, path), i.nodes(spark, path)).select("src", "predicate", "dst")


@query("CAS9", """SELECT 'SP' || c.case_id AS specimen_id, a.dst AS ihc_id, b.dst AS ish_id, k.dst AS category FROM cases c
 LEFT JOIN specimen_edges a ON a.src = 'SP' || c.case_id AND a.predicate = 'hasIHCScore' LEFT JOIN specimen_edges b ON b.src = 'SP' || c.case_id AND b.predicate = 'hasISHGroup'
 LEFT JOIN specimen_edges k ON k.src = 'SP' || c.case_id AND k.predicate = 'classifiedAs'""", ("cases", "specimen_edges"))
def cas9(spark, path):
    return c.specimen_consistency(*i.specimens(spark, path))


# ---- decision tables ---------------------------------------------------------
def _dn(spark, path):
    return i.decision_nodes(spark, path)


def _em(spark, path):
    return a.emitted_edges(_dn(spark, path), i.explicit_edges(spark, path))


def _order():
    return F.col("node_order").cast("bigint").alias("node_order")


@query("ALG1", """SELECT id, question, coalesce(type, 'decision') AS node_type, algorithm_id, j AS node_order, coalesce(label, id) AS label, result, category FROM decision_nodes""", ("decision_nodes",))
def alg1(spark, path):
    return a.flatten(_dn(spark, path)).select("id", "question", "node_type", "algorithm_id", _order(), "label", "result", "category")


@query("ALG2", "SELECT from_id AS id, to_id AS target, condition AS branch FROM emitted_edges WHERE step >= 2", ("emitted_edges",))
def alg2(spark, path):
    both = F.array(F.struct(F.lit("YES").alias("branch"), a.branch_target(F.col("if_yes")).alias("target")), F.struct(F.lit("NO").alias("branch"), a.branch_target(F.col("if_no")).alias("target")))
    return _dn(spark, path).select("id", F.explode(both).alias("b")).select("id", "b.*").filter("target is not null")


@query("ALG3", "SELECT * FROM merged_edges", ("merged_edges",))
def alg3(spark, path):
    return a.merged_edges(_em(spark, path))


@query("ALG4", """SELECT algorithm_id, n.nodes, coalesce(e.edges, 0) AS edges, coalesce(m.distinct_edges, 0) AS distinct_edges FROM (SELECT algorithm_id, count(*) AS nodes FROM decision_nodes GROUP BY 1) n
 LEFT JOIN (SELECT algorithm_id, count(*) AS edges FROM emitted_edges GROUP BY 1) e USING (algorithm_id) LEFT JOIN (SELECT algorithm_id, count(*) AS distinct_edges FROM merged_edges GROUP BY 1) m USING (algorithm_id)""", ("merged_edges", "decision_nodes"))
def alg4(spark, path):
    return a.totals(_dn(spark, path), _em(spark, path))


@query("ALG5", "SELECT algorithm_id, j AS node_order, id, question FROM decision_nodes", ("decision_nodes",))
def alg5(spark, path):
    return a.listing(_dn(spark, path)).select("algorithm_id", _order(), "id", "question")


@query("ALG6", "SELECT start, node AS id, min(depth)::BIGINT AS depth FROM w WHERE depth > 0 GROUP BY 1, 2", ("merged_edges", "decision_nodes"),
       "w AS (SELECT id AS start, id AS node, 0 AS depth FROM decision_nodes WHERE j = 0 UNION SELECT w.start, e.to_id, w.depth + 1 FROM w JOIN merged_edges e ON e.from_id = w.node WHERE w.depth < 10)")
def alg6(spark, path):
    starts = _dn(spark, path).filter(F.col("id") == p.default_entry(F.col("algorithm_id"))).select("id")
    return p.reachable(starts, a.graph_edges(alg3(spark, path))).withColumn("depth", F.col("depth").cast("bigint"))


@query("ALG7", "SELECT from_id, to_id, condition FROM merged_edges WHERE to_id NOT IN (SELECT id FROM decision_nodes) AND NOT starts_with(to_id, 'Score')", ("merged_edges", "decision_nodes"))
def alg7(spark, path):
    known = _dn(spark, path).select("id").unionByName(v.seed_entities_df(spark).filter(F.col("type") == "IHCScore").select("id"))
    return a.unknown_ends(alg3(spark, path), known).select("from_id", "to_id", "condition")


@query("ALG8", "SELECT algorithm_id, 0::BIGINT AS repeated_ids, count(CASE WHEN type IS NULL THEN 1 END) AS incomplete FROM decision_nodes GROUP BY 1", ("decision_nodes",))
def alg8(spark, path):
    return a.defects(_dn(spark, path))


# ---- paths -------------------------------------------------------------------
_KEYED = "SELECT src, predicate, dst, src || '>' || predicate || '>' || dst AS key FROM path_edges WHERE predicate IN {}"
_RANK = """SELECT start, array_to_string(nodes, '>') AS path, node AS "end", depth::BIGINT AS depth, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, array_to_string(nodes, chr(31)), array_to_string(preds, chr(31))) AS rn
 FROM {w} WHERE node IN (SELECT id FROM path_nodes WHERE type = 'ClinicalCategory')) WHERE rn <= 5"""
_W1 = d.walk("w1", "SELECT id FROM path_nodes WHERE type = 'IHCScore'", _KEYED.format("('implies', 'requiresReflexTest', 'leadsTo')"), 5)
_W2 = d.walk("w2", "SELECT id FROM path_nodes WHERE type = 'ISHGroup'", _KEYED.format("('leadsTo')"), 4)
_PG = ("path_edges", "path_nodes")


def _shown(paths):
    return paths.select("start", F.array_join("nodes", ">").alias("path"), "end", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"))


@query("PTH1", _RANK.format(w="w1"), _PG, _W1)
def pth1(spark, path):
    return _shown(p.score_paths(*i.path_graph(spark, path)))


@query("PTH2", _RANK.format(w="w2"), _PG, _W2)
def pth2(spark, path):
    return _shown(p.ish_paths(*i.path_graph(spark, path)))


@query("PTH3", """SELECT c.c_custkey AS request, coalesce(x."end", y."end") AS final_classification FROM customer c LEFT JOIN (SELECT * FROM r1 WHERE rank = 1) x ON x.start = 'C' || c.c_custkey
 LEFT JOIN (SELECT * FROM r2 WHERE rank = 1) y ON y.start = 'S' || (c.c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier))""", _PG,
       _W1 + ", " + _W2 + ", r1 AS (" + _RANK.format(w="w1") + "), r2 AS (" + _RANK.format(w="w2") + ")")
def pth3(spark, path):
    n, e = i.path_graph(spark, path)
    k = F.col("c_custkey")
    requests = i.read(spark, path, "customer").select(k.alias("request"), i._id("C", "c_custkey").alias("ihc_id"), F.concat(F.lit("S"), (k % i.key_range(spark, path, "supplier", "s_suppkey")).cast("string")).alias("ish_id"))
    return p.pathway(requests, p.score_paths(n, e), p.ish_paths(n, e)).select("request", "final_classification")


_W4 = d.walk("w4", "SELECT id FROM decision_nodes WHERE j = 0", "SELECT from_id AS src, 'leadsTo' AS predicate, to_id AS dst, from_id || '>' || to_id || '>' || condition || algorithm_id AS key FROM merged_edges", 8)


@query("PTH4", """SELECT start, path, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, t) AS rank FROM (SELECT DISTINCT start, array_to_string(nodes, '>') AS path, array_to_string(nodes, chr(31)) AS t, depth::BIGINT AS depth
 FROM w4 WHERE depth > 0)) WHERE rank <= 20""", ("merged_edges", "decision_nodes"), _W4)
def pth4(spark, path):
    return p.algorithm_paths(_dn(spark, path), a.graph_edges(alg3(spark, path))).select(
        "start", F.array_join("nodes", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"))


@query("PTH5", _RANK.format(w="w1").replace("rn <= 5", "rn = 1"), _PG, _W1)
def pth5(spark, path):
    return _shown(p.score_paths(*i.path_graph(spark, path)).filter(F.col("rank") == 1))


@query("PTH6", "SELECT src AS start, src || '>' || min(dst) AS path FROM path_edges WHERE src IN (SELECT id FROM path_nodes WHERE type = 'IHCScore') AND predicate IN ('implies', 'requiresReflexTest', 'leadsTo') GROUP BY src", _PG)
def pth6(spark, path):
    n, e = i.path_graph(spark, path)
    return p.first_path(p.typed(n, "IHCScore"), e).select("start", F.array_join("nodes", ">").alias("path"))


@query("QRY2", "SELECT DISTINCT start, array_to_string(nodes, '>') AS path, depth::BIGINT AS depth FROM w4 WHERE depth > 0", ("merged_edges", "decision_nodes"), _W4)
def qry2(spark, path):
    return p.algorithm_paths(_dn(spark, path), a.graph_edges(alg3(spark, path)), limit=None).select(
        "start", F.array_join("nodes", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"))


@query("QRY5", "SELECT src, dst FROM clinical_edges WHERE predicate = 'implies' AND src IN (SELECT id FROM clinical_nodes WHERE type = 'IHCScore') AND dst IN (SELECT id FROM clinical_nodes WHERE type = 'ClinicalCategory')",
       ("clinical_edges", "clinical_nodes"))
def qry5(spark, path):
    n, e = i.clinical_graph(spark, path)
    return g.implied_categories(n, e)


@query("QRY8", """SELECT s.src AS score, s.dst || '>' || array_to_string(w.nodes, '>') AS path FROM path_edges s JOIN path_edges t ON t.src = s.dst AND t.predicate = 'resultsIn' JOIN w2 w ON w.start = t.dst
 WHERE s.predicate = 'requiresReflexTest' AND w.depth > 0 AND w.node IN (SELECT id FROM path_nodes WHERE type = 'ClinicalCategory')""", _PG, _W2)
def qry8(spark, path):
    out = p.assay_pathway(*i.path_graph(spark, path))
    return out.select("score", F.array_join(F.slice("nodes", F.lit(2), F.size("nodes") - 1), ">").alias("path"))


# ---- rules -------------------------------------------------------------------
def _both(spark, path):
    """Clinical graph together with the star-schema graph."""
    n, e = i.clinical_graph(spark, path)
    return n.unionByName(i.nodes(spark, path)), e.unionByName(i.edges(spark, path))


_N, _E = "SELECT type, id FROM clinical_nodes UNION ALL SELECT type, id FROM nodes", "SELECT src, predicate, dst, is_hypothesis FROM clinical_edges UNION ALL SELECT src, predicate, dst, is_hypothesis FROM edges"


def _link(s, pred, t):
    return f"EXISTS (SELECT 1 FROM ae WHERE src = '{s}' AND predicate = '{pred}' AND dst = '{t}')"


_TRUTH = {rule: _link(s, pred, t) for rule, _, s, pred, _, t in rules._LINKS}
_TRUTH |= {
    "IHC2Plus_requires_ISH": "EXISTS (SELECT 1 FROM ae WHERE src = 'Score2Plus' AND predicate = 'requiresReflexTest')",
    "Positive_disjoint_Negative": f"NOT {_link('HER2_Positive', 'refinesCategory', 'HER2_Negative')} AND NOT {_link('HER2_Negative', 'refinesCategory', 'HER2_Positive')}",
    "Fractal_marked_as_hypothesis": "NOT EXISTS (SELECT 1 FROM ae WHERE predicate = 'proposedEquivalence' AND is_hypothesis IS DISTINCT FROM true AND src IN (SELECT id FROM an WHERE type = 'FractalMetric'))",
    "All_5_categories_present": f"(SELECT count(DISTINCT id) FROM an WHERE type = 'ClinicalCategory' AND list_contains({sql_list(v.CATEGORY_IDS)}, id)) = 6",
    "All_5_ISH_groups_present": f"(SELECT count(DISTINCT id) FROM an WHERE type = 'ISHGroup' AND list_contains({sql_list(v.ISH_GROUP_IDS)}, id)) = 5",
    "Equivocal_has_no_direct_therapy": "NOT EXISTS (SELECT 1 FROM ae WHERE src = 'HER2_Equivocal' AND predicate = 'eligibleFor')",
    "No_orphan_entities": "NOT EXISTS (SELECT 1 FROM an WHERE type IN ('ClinicalCategory', 'IHCScore', 'ISHGroup') AND id NOT IN (SELECT src FROM ae) AND id NOT IN (SELECT dst FROM ae))",
}
_USE = ("clinical_nodes", "clinical_edges", "nodes", "edges")
_CTE = f"an AS ({_N}), ae AS ({_E})"
_RULE_SQL = " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, '{level}' AS severity, ({_TRUTH[rule]}) AS valid" for rule, level, _, _ in rules.RULES)


def _one_rule(rule):
    def run(spark, path):
        return rules.run(*_both(spark, path), only=[rule]).select("rule_id", "severity", "valid")
    return run


for _n, (_rule, _level, _, _) in enumerate(rules.RULES, 1):
    query(f"VAL{_n}", f"SELECT '{_rule}' AS rule_id, '{_level}' AS severity, ({_TRUTH[_rule]}) AS valid", _USE, _CTE)(_one_rule(_rule))


@query("VAL14", _RULE_SQL, _USE, _CTE)
def val14(spark, path):
    return rules.run(*_both(spark, path)).select("rule_id", "severity", "valid")


@query("VAL15", f"""SELECT count(*) AS total, count(CASE WHEN valid THEN 1 END) AS passed, count(CASE WHEN NOT valid THEN 1 END) AS failed,
 count(CASE WHEN NOT valid AND severity = 'CRITICAL' THEN 1 END) AS critical, count(CASE WHEN NOT valid AND severity IN ('CRITICAL', 'HIGH') THEN 1 END) = 0 AS is_consistent FROM ({_RULE_SQL})""", _USE, _CTE)
def val15(spark, path):
    return rules.report(rules.run(*_both(spark, path)))


@query("MET1", f"""SELECT (SELECT avg(CASE WHEN child IN (SELECT id FROM an) OR child IN (SELECT type FROM an) THEN 1.0 ELSE 0.0 END) FROM v_hierarchy)::DOUBLE AS entity_coverage,
 (SELECT count(DISTINCT predicate) FROM ae WHERE list_contains({sql_list(v.PREDICATES)}, predicate))::DOUBLE / {len(v.PREDICATES)} AS predicate_coverage,
 (SELECT count(CASE WHEN s THEN 1 END)::DOUBLE / count(*) FROM (SELECT true AS s FROM v_seed_nodes UNION ALL SELECT false FROM cases UNION ALL SELECT source_doc IS NOT NULL FROM nodes WHERE type <> 'Chunk')) AS provenance""",
       (*_USE, "v_hierarchy", "v_seed_nodes", "cases"), _CTE)
def met1(spark, path):
    n, e = _both(spark, path)
    return g.quality_metrics(n, e, v.class_hierarchy_df(spark), v.PREDICATES)
