"""Registered queries: retrieval, evidence, context, user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as c, retrieval as t
from ..sources import vocabulary as v
from . import duck_inputs as d, inputs as i  # noqa: F401
from .registry import query, table, values


def _big(name):
    return F.col(name).cast("bigint").alias(name)


def _graph(spark, path):
    return i.mention_pairs(spark, path), i.chunks(spark, path), i.nodes(spark, path), i.edges(spark, path)


_RET1 = """SELECT request_id, chunk_id, entity_id, entity, relation, related_entity, confidence, source_doc, rank FROM (
 SELECT q.request_id, m.chunk_id, q.entity_id, n.label AS entity, e.predicate AS relation, e.label AS related_entity, e.confidence, c.source_doc,
 row_number() OVER (PARTITION BY q.request_id ORDER BY e.confidence DESC NULLS FIRST, q.entity_id, e.predicate NULLS FIRST, e.dst NULLS FIRST, m.chunk_id) AS rank
 FROM asked q JOIN mention_pairs m ON m.entity_id = q.entity_id JOIN chunks c ON c.chunk_id = m.chunk_id JOIN nodes n ON n.id = q.entity_id
 LEFT JOIN (SELECT e.*, x.label FROM edges e JOIN nodes x ON x.id = e.dst) e ON e.src = q.entity_id) WHERE rank <= 20"""
_G = ("mention_pairs", "chunks", "nodes", "edges")


def _ret1_cols(df):
    return df.select("request_id", "chunk_id", "entity_id", "entity", "relation", "related_entity", "confidence", "source_doc", _big("rank"))


@query("RET1", _RET1, ("requests", *_G), "asked AS (SELECT DISTINCT request_id, unnest(entity_ids) AS entity_id FROM requests)")
def ret1(spark, path):
    asked = i.requests(spark, path).select("request_id", F.explode("entity_ids").alias("entity_id"))
    return _ret1_cols(t.retrieve(asked, *_graph(spark, path)))


@query("RET2", "SELECT needle, id, label, node_type, rank FROM label_hits", ("label_hits",))
def ret2(spark, path):
    return t.find_by_label(i.label_needles(spark, path), i.nodes(spark, path)).select("needle", "id", "label", "node_type", _big("rank"))


@query("RET3", _RET1, _G, """lr AS (SELECT p_partkey AS request_id, unnest(string_split(p_name, ' ')) AS needle FROM part),
lh AS (SELECT * FROM (SELECT n.needle, m.id, row_number() OVER (PARTITION BY n.needle ORDER BY len(m.label), m.id, m.type) AS rank FROM (SELECT DISTINCT needle FROM lr) n
 JOIN nodes m ON contains(lower(m.label), lower(n.needle)) WHERE m.type <> 'Chunk') WHERE rank <= 10),
asked AS (SELECT DISTINCT lr.request_id, lh.id AS entity_id FROM lr JOIN lh USING (needle))""")
def ret3(spark, path):
    return _ret1_cols(t.retrieve_by_labels(i.label_requests(spark, path), *_graph(spark, path)))


@query("RET4", "SELECT query_id, kw_pos, chunk_id, source_doc, rank FROM evidence_rows", ("evidence_rows",))
def ret4(spark, path):
    return t.evidence(i.queries(spark, path), i.answer_chunks(spark, path), count=3, chars=80).select("query_id", _big("kw_pos"), "chunk_id", "source_doc", _big("rank"))


@query("RET5", "SELECT query_id, array_to_string(kws, '|') AS keywords FROM query_keywords", ("query_keywords",))
def ret5(spark, path):
    return i.queries(spark, path).select("query_id", F.array_join(t.keywords(F.col("query"), 3, 80), "|").alias("keywords"))


@query("RET6", """SELECT case_id, CASE WHEN classification = category THEN classification ELSE classification || ',' || category END AS ids FROM classified""", ("classified",))
def ret6(spark, path):
    return c.classify(i.cases(spark, path)).select("case_id", F.array_join(t.categories(F.array("classification"), F.col("category")), ",").alias("ids"))


_ELIG = """SELECT e.src AS category_id, c.label AS category, e.predicate AS eligibility, e.dst AS drug_id, p.label AS drug, e.clinical_context AS context, NULL::VARCHAR AS trial
 FROM eligibility e JOIN nodes c ON c.id = e.src AND c.type = 'ClinicalCategory' JOIN nodes p ON p.id = e.dst AND p.type = 'TherapeuticAgent'"""


@query("RET7", _ELIG, ("eligibility", "nodes"))
def ret7(spark, path):
    return t.eligibility(i.nodes(spark, path), i.edges(spark, path))


@query("RET7_by_id", _ELIG + " WHERE e.src IN (SELECT 'S' || n_nationkey FROM nation)", ("eligibility", "nodes"))
def ret7_by_id(spark, path):
    ids = i.read(spark, path, "nation").select(i._id("S", "n_nationkey").alias("category_id"))
    return t.eligibility(i.nodes(spark, path), i.edges(spark, path), ids)


@query("RET8", """SELECT query_id, source_doc AS source, content_type AS type, left(context, 150) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_pos, rank) AS n FROM evidence_rows) WHERE n <= 5""",
       ("evidence_rows",))
def ret8(spark, path):
    return t.citations(t.evidence(i.queries(spark, path), i.answer_chunks(spark, path), first=t.CITATIONS)).select("query_id", "source", "type", "text")


@query("RET9", """SELECT needle, guideline_id, topic, year, rank FROM (SELECT k.needle, g.src AS guideline_id, x.label AS topic, 2000 + substr(g.src, 2)::BIGINT % 26 AS year,
 row_number() OVER (PARTITION BY k.needle ORDER BY 2000 + substr(g.src, 2)::BIGINT % 26 DESC, g.src, g.dst) AS rank FROM label_needles k JOIN live_edges g ON g.predicate = 'covers'
 JOIN nodes n ON n.id = g.src JOIN nodes x ON x.id = g.dst WHERE contains(lower(n.label), lower(k.needle)) OR contains(lower(x.label), lower(k.needle))) WHERE rank <= 10""",
       ("label_needles", "live_edges", "nodes"))
def ret9(spark, path):
    return t.guideline_topics(i.label_needles(spark, path), i.nodes(spark, path), i.edges(spark, path)).select("needle", "guideline_id", "topic", "year", _big("rank"))


table("v_guides", values([(k, "|".join(g)) for k, g in v.EVIDENCE_GUIDELINES.items()], ["category", "guidelines"]))


@query("RET10", """SELECT c.case_id, c.category, e.eligible_agents, e.not_eligible_agents, g.guidelines, g.guidelines IS NOT NULL AS found FROM cases c
 LEFT JOIN v_guides g ON g.category = replace(c.category, '-', '_')
 LEFT JOIN (SELECT category, coalesce(string_agg(CASE WHEN eligible THEN agent END, ', ' ORDER BY agent), '') AS eligible_agents, coalesce(string_agg(CASE WHEN NOT eligible THEN agent END, ', ' ORDER BY agent), '') AS not_eligible_agents
 FROM v_evidence GROUP BY 1) e ON e.category = g.category""", ("cases", "v_guides", "v_evidence"))
def ret10(spark, path):
    return t.static_evidence(i.cases(spark, path).select("case_id", "category"), v.evidence_df(spark), v.evidence_guidelines_df(spark)).select(
        "case_id", "category", "eligible_agents", "not_eligible_agents", F.array_join("guidelines", "|").alias("guidelines"), "found")


@query("RET11", "SELECT id, label, (2000 + substr(id, 2)::BIGINT % 26)::DOUBLE AS score FROM nodes WHERE type = 'Guideline'", ("nodes",))
def ret11(spark, path):
    return t.scoring_criteria(i.nodes(spark, path), "Guideline", "year").select("id", "label", "score")


_CORR = """SELECT m.label AS metric, e.src AS metric_id, e.confidence AS correlation, e.dst AS category FROM edges e JOIN nodes m ON m.id = e.src JOIN nodes c ON c.id = e.dst
 WHERE e.predicate = 'proposedEquivalence' AND m.type = 'ISHGroup' AND c.type = 'ClinicalCategory'"""


@query("RET12", _CORR + " ORDER BY correlation DESC NULLS FIRST, metric_id, category LIMIT 5", ("edges", "nodes"))
def ret12(spark, path):
    return t.correlations(i.nodes(spark, path), i.edges(spark, path), kind="ISHGroup", strength=F.col("confidence")).drop("category_label")


@query("QRY7", _CORR, ("edges", "nodes"))
def qry7(spark, path):
    return t.correlations(i.nodes(spark, path), i.edges(spark, path), None, "ISHGroup", F.col("confidence")).drop("category_label")


@query("RET13", """SELECT case_id, replace(steps, '|', ' → ') AS text, len(string_split(replace(steps, '|', ' → '), ' → ')) AS n_parts FROM classified""", ("classified",))
def ret13(spark, path):
    one = c.classify(i.cases(spark, path)).select("case_id", t.pathway_text(F.col("pathway_steps")).alias("text"))
    return one.withColumn("n_parts", F.size(t.pathway_steps(F.col("text"))).cast("bigint"))


def _asked(spark, path):
    m, ch, n, e = _graph(spark, path)
    return i.requests(spark, path), n, e, m, ch


@query("RET14", "SELECT request_id, entity_id, node_type, relation, related_entity, confidence, context, source_doc, rank FROM context_rows", ("context_rows",))
def ret14(spark, path):
    return t.context_rows(*_asked(spark, path)).select("request_id", "entity_id", "node_type", "relation", "related_entity", "confidence", "context", "source_doc", _big("rank"))


@query("RET15", """SELECT request_id, array_to_string(list_sort(list(DISTINCT entity_id || '/' || label || '/' || node_type)), '|') AS entities,
 count(DISTINCT CASE WHEN relation IS NOT NULL AND coalesce(related_entity, '') <> '' THEN label || relation || related_entity || coalesce(confidence::VARCHAR, '') END) AS n_relations,
 count(DISTINCT source_doc || context) AS n_chunks, coalesce(array_to_string(list_sort(list(DISTINCT source_doc) FILTER (source_doc IS NOT NULL)), ','), '') AS sources FROM context_rows GROUP BY 1""", ("context_rows",))
def ret15(spark, path):
    f = t.fold_context(t.context(*_asked(spark, path)))
    return f.select("request_id", F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat_ws("/", e["entity_id"], e["label"], e["node_type"]))), "|").alias("entities"),
                    F.size("relations").cast("bigint").alias("n_relations"), F.size("chunks").cast("bigint").alias("n_chunks"), F.array_join("source_docs", ",").alias("sources"))


@query("RET16", """SELECT case_id, array_to_string(ids, ',') AS ids FROM (SELECT case_id, ['Group1'] || list_filter([CASE ihc_score WHEN '3+' THEN 'Score3Plus' WHEN '2+' THEN 'Score2Plus' WHEN '1+' THEN 'Score1Plus'
 WHEN '0+' THEN 'Score0Plus' WHEN '0' THEN 'Score0' END, CASE WHEN ish_group <> '' AND ish_group <> 'Group1' THEN ish_group END], lambda x: x IS NOT NULL) AS ids FROM cases)""", ("cases",))
def ret16(spark, path):
    return i.cases(spark, path).select("case_id", F.array_join(t.case_entity_ids(F.array(F.lit("Group1")), F.col("ihc_score"), F.col("ish_group")), ",").alias("ids"))


@query("RET17", """SELECT request_id, array_to_string(list_transform(entity_ids, lambda x: x || '/' || replace(x, '_', ' ')), '|') AS entities, 31::BIGINT AS n_labels FROM requests""", ("requests",))
def ret17(spark, path):
    return t.fallback_context(i.requests(spark, path)).select(
        "request_id", F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["entity_id"], e["label"])), "|").alias("entities"), F.size("entity_labels").cast("bigint").alias("n_labels"))


@query("RET18", r"""SELECT request_id, '### GROUNDED CONTEXT (verified KG facts)' || chr(10) || chr(10) || '**Entities:**' || chr(10)
 || array_to_string(list_transform(ents[1:15], lambda z: '  - [' || z.t || '] ' || z.l || ' (id: ' || z.i || ')'), chr(10))
 || CASE WHEN len(rels) > 0 THEN chr(10) || chr(10) || '**Relations:**' || chr(10) || array_to_string(list_transform(rels[1:15], lambda z: '  - ' || z.a || ' --[' || z.b || ']--> ' || z.c
   || CASE WHEN coalesce(z.d, 0) <> 0 THEN ' [confidence=' || z.d || ']' ELSE '' END), chr(10)) ELSE '' END
 || CASE WHEN len(chs) > 0 THEN chr(10) || chr(10) || '**Source excerpts:**' || chr(10) || array_to_string(list_transform(chs[1:3], lambda z: '  [' || z.s || '] ' || left(z.x, 300)), chr(10)) ELSE '' END
 || CASE WHEN len(srcs) > 0 THEN chr(10) || chr(10) || '**Sources:** ' || array_to_string(srcs, ', ') ELSE '' END
 || chr(10) || chr(10) || '> IMPORTANT: Only reference the above entities and relations in your response.' AS prompt_context
FROM (SELECT request_id, list_sort(list(DISTINCT {i: entity_id, l: label, t: node_type})) AS ents,
 list_sort(coalesce(list(DISTINCT {a: label, b: relation, c: related_entity, d: confidence}) FILTER (relation IS NOT NULL AND coalesce(related_entity, '') <> ''), []), 'ASC', 'NULLS FIRST') AS rels,
 list_sort(coalesce(list(DISTINCT {s: source_doc, x: context}) FILTER (context IS NOT NULL), [])) AS chs, list_sort(coalesce(list(DISTINCT source_doc) FILTER (source_doc IS NOT NULL), [])) AS srcs
 FROM context_rows GROUP BY 1)""", ("context_rows",))
def ret18(spark, path):
    return t.context_text(t.fold_context(t.context(*_asked(spark, path)))).select("request_id", "prompt_context")


@query("QRY1", """SELECT c.label AS category, e.predicate, n.label AS target FROM edges e JOIN nodes c ON c.id = e.src AND c.type = 'ClinicalCategory' JOIN nodes n ON n.id = e.dst
 ORDER BY e.src, e.predicate, e.dst, n.label LIMIT 30""", ("edges", "nodes"))
def qry1(spark, path):
    return t.category_edges(i.nodes(spark, path), i.edges(spark, path)).select("category", "predicate", "target")


@query("QRY3", "SELECT category_id, category, drug_id, drug FROM (" + _ELIG + ") WHERE eligibility = 'eligibleFor' AND contains(drug, 'ring')", ("eligibility", "nodes"))
def qry3(spark, path):
    return t.eligible_categories(i.nodes(spark, path), i.edges(spark, path), "ring")


@query("QRY4", "SELECT type, count(*) AS n FROM (SELECT type FROM clinical_nodes UNION ALL SELECT type FROM nodes) GROUP BY 1", ("clinical_nodes", "nodes"))
def qry4(spark, path):
    from ..operators.graph import node_counts
    n, _ = i.clinical_graph(spark, path)
    return node_counts(n.unionByName(i.nodes(spark, path)))


_AGENTS = ["T-DXd", "Trastuzumab", "Pertuzumab", "Tucatinib"]
_CELLS = ", ".join(f"""(SELECT string_agg(DISTINCT CASE WHEN eligible THEN 'eligible' ELSE 'not eligible' END, ' / ' ORDER BY CASE WHEN eligible THEN 'eligible' ELSE 'not eligible' END)
 FROM v_evidence e WHERE e.category = c.category AND e.agent = '{a}') AS "{a}" """ for a in _AGENTS)


@query("QRY6", f"SELECT c.category, c.cases, {_CELLS} FROM (SELECT classification AS category, count(*) AS cases FROM classified GROUP BY 1) c", ("classified", "v_evidence"))
def qry6(spark, path):
    m = t.eligibility_matrix(c.classify(i.cases(spark, path)), v.evidence_df(spark), _AGENTS)
    return m.select("category", "cases", *[F.when(F.col(f"`{a}`") != "", F.col(f"`{a}`")).alias(a) for a in _AGENTS])
