"""The inputs of ``inputs`` stated in SQL, for checking only."""

from __future__ import annotations

from . import inputs as i
from ..operators import routing
from ..sources import vocabulary as v
from .registry import sql_list, table, values


def pick(items, index):
    return f"{sql_list(items)}[(({index}) % {len(items)} + 1)::INT]"


ISH_SQL = """CASE WHEN {r} IS NULL OR {s} IS NULL THEN NULL
 WHEN {r} >= 2 AND {s} >= 4 THEN 'Group1' WHEN {r} >= 2 THEN 'Group2'
 WHEN {s} >= 6 THEN 'Group3' WHEN {s} >= 4 THEN 'Group4' ELSE 'Group5' END"""

table("cases", f"""
SELECT event_id AS case_id, {pick(i.CASE_SCORES, 'event_id')} AS ihc_score,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '5' WHEN event_id % 13 = 0 THEN ''
  ELSE {ISH_SQL.format(r='(value / 5.0::DOUBLE)', s='((user_id % 80) / 10.0::DOUBLE)')} END AS ish_group,
 value / 5.0::DOUBLE AS ish_ratio, (user_id % 80) / 10.0::DOUBLE AS signals_per_cell,
 CASE WHEN event_id % 5 <> 0 THEN (130 + event_id % 80) / 100.0::DOUBLE END AS fractal_d0,
 {pick(i.CASE_CATEGORIES, 'user_id')} AS category
FROM events""")

table("correlations", f"""
SELECT {pick(v.CATEGORY_IDS, 'n_nationkey')} AS category_id, n_name AS metric_label,
 (100 + n_nationkey * 3) / 100.0::DOUBLE AS d0_low, (140 + n_nationkey * 2) / 100.0::DOUBLE AS d0_high FROM nation""")

table("queries", f"""
SELECT conv_id * 100 + turn AS query_id, 'T' || conv_id AS thread_id,
 text || ' ' || {pick(i.QUERY_PHRASES, 'conv_id + turn')} AS query, (conv_id + turn) % 5 = 0 AS has_case,
 {pick(i.ROUTER_RAW, 'conv_id * 3 + turn')} AS router_raw,
 list_filter(string_split({pick(i.RAN, 'conv_id')}, ','), lambda a: a <> '') AS ran, conv_id % 4 AS iteration
FROM conversations WHERE role = 'user'""")

table("responses", f"""
SELECT conv_id * 100 + turn AS response_id,
 text || ' ' || {pick(i.RESPONSE_PHRASES, 'conv_id * 7 + turn')} AS response,
 {pick(i.RESPONSE_SCORES, 'conv_id + turn')} AS ihc_score,
 CASE WHEN (conv_id + turn) % 2 = 0 THEN 'Group1' END AS ish_group,
 CASE WHEN conv_id % 4 = 0 THEN ['kadcyla'] ELSE []::VARCHAR[] END AS context_labels,
 conv_id % 6 <> 0 AS has_case
FROM conversations WHERE role = 'assistant'""")

_hit = {a: " OR ".join(f"contains(lower(query), '{t}')" for t in routing.TRIGGERS[a]) for a in routing.AGENTS}
table("keyword_routes", f"""
SELECT query_id, CASE WHEN len(a) = 0 THEN ['diagnostic'] ELSE a END AS agents FROM (
 SELECT query_id, list_filter([CASE WHEN has_case OR {_hit['diagnostic']} THEN 'diagnostic' END,
  CASE WHEN {_hit['evidence']} THEN 'evidence' END, CASE WHEN {_hit['explanation']} THEN 'explanation' END,
  CASE WHEN {_hit['validation']} THEN 'validation' END], lambda x: x IS NOT NULL) AS a FROM queries)""", "queries")

_known = sql_list(routing.AGENTS)
table("parsed_routes", f"""
SELECT query_id, list_filter(list_transform(list_reverse(regexp_extract_all(
   trim(regexp_replace(router_raw, '(?s)<think>.*?</think>', '', 'g')), '(?s)\\[.*?\\]')),
  lambda m: CASE WHEN json_valid(m) THEN list_filter(from_json(m, '["VARCHAR"]'), lambda n: list_contains({_known}, n)) ELSE []::VARCHAR[] END),
  lambda l: len(l) > 0) AS found FROM queries""", "queries")

table("routes", """
SELECT q.*, CASE WHEN len(p.found) > 0 THEN p.found[1] ELSE k.agents END AS target_agents
FROM queries q JOIN parsed_routes p USING (query_id) JOIN keyword_routes k USING (query_id)""",
      "parsed_routes", "keyword_routes")

table("agent_results", f"""
SELECT query_id, thread_id, seq, agent, {pick(['HIGH', 'MEDIUM', 'LOW', 'odd', ''], 'query_id + seq')} AS confidence,
 CASE WHEN agent = 'validation' THEN query_id % 3 END AS critical_count,
 'text of ' || agent || ' for ' || query_id AS narrative
FROM (SELECT k.query_id, q.thread_id, unnest(k.agents) AS agent, generate_subscripts(k.agents, 1) - 1 AS seq
      FROM keyword_routes k JOIN queries q USING (query_id))""", "keyword_routes")

# ---- vocabulary as literal tables -----------------------------------------
table("v_seed_nodes", values([(t, n, lab, u, d) for n, lab, t, u, d, _ in v.SEED_ENTITIES],
                             ["type", "id", "label", "ncit_uri", "definition"]))
table("v_seed_edges", values([r[:4] + r[6:] for r in v.SEED_RELATIONS],
                             ["src", "predicate", "dst", "confidence", "is_hypothesis"]))
table("v_evidence", values(v.STATIC_EVIDENCE, ["category", "agent", "eligible", "context", "trial"]))
table("v_canonical", values([(k, u, n) for n, (k, u) in enumerate(v.CANONICAL_URIS.items())], ["label", "uri", "ord"]))
table("v_snomed", values(list(v.SNOMED_URIS.items()), ["label", "snomed_uri"]))
table("v_hierarchy", values(v.class_hierarchy_rows(), ["parent", "child"]))

# ---- documents -------------------------------------------------------------


def newlines(text):
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


_extras = "[" + ", ".join(newlines(x) for x in i.MD_EXTRAS) + "]"
table("markdown_docs", f"""
SELECT 'conv_' || lpad(conv_id::VARCHAR, 8, '0') || '.md' AS source_doc, 'conv_' || lpad(conv_id::VARCHAR, 8, '0') AS stem,
 CASE WHEN conv_id % 3 = 0 THEN '# Conversation' || chr(10) || 'words that parity drops' || chr(10)
  ELSE 'Opening words of conversation number ' || conv_id || ' that are long enough for a chunk.' || chr(10) END
 || string_agg(chr(10) || '## ' || role || ' ' || turn || chr(10) || text || chr(10)
  || {_extras}[((conv_id + turn) % {len(i.MD_EXTRAS)} + 1)::INT] || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
table("page_rows", """
SELECT 'Doc-' || doc_id || '.pdf' AS source_doc, unnest(t) AS text, generate_subscripts(t, 1)::BIGINT AS page_num
FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)""")


def ctype(text):
    """Content type of a text in SQL."""
    from ..operators.chunking import TYPE_PATTERNS
    pairs = []
    for name, pattern in TYPE_PATTERNS.items():
        flags = "(?m)" if name == "table" else "(?i)"
        quoted = (flags + pattern).replace("'", "''")
        pairs.append((name, f"len(regexp_extract_all({text}, '{quoted}'))"))
    best = "greatest(" + ", ".join(count for _, count in pairs) + ")"
    return ("CASE WHEN " + best + " = 0 THEN 'general' "
            + " ".join(f"WHEN {count} = {best} THEN '{name}'" for name, count in pairs) + " END")


def window_tables(source, key, name, size=500, overlap=100):
    """CTEs that fold the sentences of ``source(key, text)`` into windows (key, n, content)."""
    k = ", ".join(key)
    using = " AND ".join(f"w.{c} = s.{c}" for c in key)
    return f"""
{name}_s AS (SELECT {k}, list_transform(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-ZÁÉÍÓÚÑ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
   lambda x: list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) AS sw FROM {source}),
{name}_f AS (SELECT {k}, 0 AS i, 0 AS st, 0 AS ln, -1 AS es, -1 AS el FROM {name}_s
 UNION ALL SELECT {', '.join('w.' + c for c in key)}, i + 1,
  CASE WHEN c THEN st + ln - least({overlap}, ln) ELSE st END, CASE WHEN c THEN least({overlap}, ln) ELSE ln END + n,
  CASE WHEN c THEN st ELSE -1 END, CASE WHEN c THEN ln ELSE -1 END
 FROM (SELECT w.*, len(s.sw[i + 1]) AS n, (ln + len(s.sw[i + 1]) > {size} AND ln > 0 AND len(s.sw[i + 1]) > 0) AS c
  FROM {name}_f w JOIN {name}_s s ON {using} WHERE i < len(s.sw)) w),
{name}_w AS (SELECT {k}, es AS st, el AS ln FROM {name}_f WHERE es >= 0
 UNION ALL SELECT {', '.join('w.' + c for c in key)}, w.st, w.ln FROM {name}_f w JOIN {name}_s s ON {using} WHERE w.i = len(s.sw) AND w.ln > 0),
{name} AS (SELECT {k}, st, array_to_string(flatten(s.sw)[w.st + 1 : w.st + w.ln], ' ') AS content
 FROM {name}_w w JOIN {name}_s s USING ({k}) WHERE len(array_to_string(flatten(s.sw)[w.st + 1 : w.st + w.ln], ' ')) >= 50)"""

# ---- extraction ------------------------------------------------------------
table("raw_extractions", f"""
SELECT chunk_id, section, CASE WHEN e % 16 = 1 THEN '```json' || chr(10) || body || chr(10) || '```'
 WHEN e % 16 = 2 THEN '<think>is it {{' || chr(10) || '}} so</think>' || chr(10) || body
 WHEN e % 16 = 3 THEN left(body, len(body) - 3) WHEN e % 16 = 4 THEN '[' || body || ']' WHEN e % 16 = 14 THEN '' ELSE body END AS raw
FROM (SELECT event_id AS e, 'c' || event_id AS chunk_id, 'S' || (event_id % 9) AS section,
 '{{"entities":[{{' || CASE WHEN event_id % 17 = 10 THEN '' ELSE '"id":"e1",' END || '"label":"' || {pick(i.EXT_LABELS, 'event_id')} || '","type":"'
 || {pick(i.EXT_TYPES, 'event_id')} || '"' || {pick(i.EXT_CONF, 'event_id')} || {pick(i.EXT_DEFS, 'event_id')} || {pick(i.EXT_URIS, 'event_id // 3')}
 || '}},{{"id":"e2"' || CASE WHEN event_id % 19 = 3 THEN '' ELSE ',"label":"' || {pick(i.EXT_LABELS, 'event_id * 5 + 2')} || '"' END
 || ',"type":"Assay","confidence":' || (50 + event_id % 50) || 'e-2' || {pick(i.EXT_DEFS, 'event_id + 1')}
 || '}}],"relations":[{{"subject_id":"e1","predicate":"' || {pick(i.EXT_PREDICATES, 'event_id')} || '","object_id":"'
 || CASE WHEN event_id % 13 = 11 THEN 'e9' ELSE 'e2' END || '","confidence":' || {pick(i.EXT_REL_CONF, 'event_id')} || ',"evidence":"seen"}}]}}' AS body
 FROM events)""")
table("ext_clean", r"""
SELECT chunk_id, section, raw, trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), chr(10) || ' '),
 '^```(?:json)?\s*', ''), '\s*```$', '')) AS j FROM raw_extractions""", "raw_extractions")
table("ext_root", "SELECT *, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j::JSON) = 'OBJECT' THEN j::JSON END END AS root FROM ext_clean", "ext_clean")
_conf = "CASE WHEN json_type({0}, '$.confidence') IS NULL THEN 1.0 WHEN json_type({0}, '$.confidence') = 'NULL' THEN NULL WHEN json_type({0}, '$.confidence') = 'BOOLEAN' THEN CASE WHEN {0}->>'confidence' = 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST({0}->>'confidence' AS DOUBLE) END"
table("ext_entities", f"""
SELECT * FROM (SELECT chunk_id, pos, x->>'id' AS id, coalesce(x->>'label', '') AS label,
 CASE WHEN list_contains({sql_list(v.NODE_TYPES)}, x->>'type') THEN x->>'type' ELSE 'ClinicalCategory' END AS type, x->>'definition' AS definition,
 x->>'candidate_uri' AS candidate_uri, ({_conf.format('x')})::DOUBLE AS confidence
 FROM (SELECT chunk_id, unnest(from_json(root->'entities', '["JSON"]')) AS x, generate_subscripts(from_json(root->'entities', '["JSON"]'), 1) AS pos FROM ext_root WHERE root IS NOT NULL)
 WHERE json_type(x, '$.id') = 'VARCHAR' AND coalesce(json_type(x, '$.definition'), 'NULL') IN ('NULL', 'VARCHAR')) WHERE confidence BETWEEN 0 AND 1""", "ext_root")
table("ext_relations", f"""
SELECT * FROM (SELECT chunk_id, x->>'subject_id' AS subject_id, x->>'predicate' AS predicate, x->>'object_id' AS object_id, ({_conf.format('x')})::DOUBLE AS confidence
 FROM (SELECT chunk_id, unnest(from_json(root->'relations', '["JSON"]')) AS x FROM ext_root WHERE root IS NOT NULL))
 WHERE list_contains({sql_list(v.PREDICATES)}, predicate) AND confidence BETWEEN 0 AND 1""", "ext_root")


def _blocklist():
    from ..operators.extraction import BLOCKLIST
    return BLOCKLIST["parity"].replace("(?iU)", "(?i)")


_open_end = "NOT EXISTS (SELECT 1 FROM {1} e WHERE e.chunk_id = r.chunk_id AND e.id = r.{0})"
table("ext_domain_e", f"SELECT * FROM ext_entities WHERE NOT regexp_matches(label, '{_blocklist()}')", "ext_entities")
table("ext_domain_r", "SELECT r.* FROM ext_relations r WHERE NOT (" + _open_end.format("subject_id", "ext_domain_e") + ") AND NOT ("
      + _open_end.format("object_id", "ext_domain_e") + ")", "ext_relations", "ext_domain_e")
table("ext_final_e", "SELECT * FROM ext_domain_e WHERE confidence >= 0.6", "ext_domain_e")
table("ext_final_r", "SELECT r.* FROM ext_domain_r r WHERE confidence >= 0.5 AND NOT (" + _open_end.format("subject_id", "ext_final_e") + ") AND NOT ("
      + _open_end.format("object_id", "ext_final_e") + ")", "ext_domain_r", "ext_final_e")

# ---- resolution ------------------------------------------------------------


def pick_null(items, index):
    cells = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in items)
    return f"([{cells}])[(({index}) % {len(items)} + 1)::INT]"


table("to_resolve", f"""
SELECT 'c' || (event_id // 8) AS chunk_id, event_id % 8 AS pos, 'e' || (event_id % 7) AS local_id, {pick(i.RES_LABELS, 'user_id + event_id // 3')} AS label,
 {pick_null(i.RES_DEFS, 'event_id // 2')} AS definition, {pick_null(i.RES_URIS, 'event_id')} AS candidate_uri, (event_id * 37 % 5 + 5) / 10.0::DOUBLE AS confidence FROM events""")
table("local_relations", f"""SELECT 'c' || (event_id // 8) AS chunk_id, 'e' || (event_id % 7) AS subject_id, {pick(['implies', 'definedIn'], 'event_id')} AS predicate,
 'e' || (event_id % 11) AS object_id FROM events""")
table("v_seed_uri", values(v.seed_uri_rows(), ["uri", "seed_id"]))
table("res_tiers", r"""
SELECT t.*, CASE WHEN regexp_matches(candidate_uri, '^(NCIt|her2|snomed):') THEN candidate_uri END AS trusted,
 coalesce(c1.uri, c2.uri) AS exact, CASE WHEN c1.uri IS NOT NULL THEN s1.snomed_uri ELSE s2.snomed_uri END AS exact_snomed,
 (SELECT arg_min(uri, ord) FROM v_canonical c WHERE lower(c.label) = lower(t.label)) AS ci,
 'her2:' || trim(regexp_replace(trim(lower(t.label)), '[^a-z0-9_]', '_', 'g'), '_') AS fallback,
 trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(trim(t.label), '>', 'gt'), '<', 'lt'), '(', ''), ')', ''), '%', 'pct'), '[-\s/]+', '_', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_') AS nid,
 regexp_replace(trim(t.label), '[-\s]+', '_', 'g') AS norm
FROM to_resolve t LEFT JOIN v_canonical c1 ON t.label = c1.label LEFT JOIN v_canonical c2 ON regexp_replace(trim(t.label), '[-\s]+', '_', 'g') = c2.label
 LEFT JOIN v_snomed s1 ON s1.label = c1.label LEFT JOIN v_snomed s2 ON s2.label = c2.label""", "to_resolve", "v_canonical", "v_snomed")
table("resolved", """
SELECT r.*, coalesce(seed_id, nid) AS id, CASE WHEN starts_with(uri_, 'NCIt:') THEN uri_ END AS ncit_uri,
 CASE WHEN starts_with(uri_, 'snomed:') THEN uri_ WHEN trusted IS NULL AND exact IS NOT NULL THEN exact_snomed END AS snomed_uri
FROM (SELECT *, coalesce(trusted, exact, ci, fallback) AS uri_ FROM res_tiers) r LEFT JOIN v_seed_uri s ON s.uri = r.uri_""", "res_tiers", "v_seed_uri")
table("res_winner", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, uri_ ORDER BY confidence DESC, pos) AS rn FROM resolved) WHERE rn = 1""", "resolved")

# ---- star-schema graph -----------------------------------------------------
table("nodes", """
SELECT 'IHCScore' AS type, 'R' || r_regionkey AS id, r_name AS label, NULL AS ncit_uri, NULL AS snomed_uri, NULL AS source_doc FROM region
UNION ALL SELECT 'ISHGroup', 'N' || n_nationkey, n_name, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'ClinicalCategory', 'S' || s_suppkey, s_name, NULL, NULL, 'ontology:seed' FROM supplier
UNION ALL SELECT 'TherapeuticAgent', 'P' || p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'NCIt:C' || p_partkey END, CASE WHEN p_partkey % 5 = 0 THEN 'snomed:' || p_partkey END, 'O' || p_partkey FROM part
UNION ALL SELECT 'Guideline', 'C' || c_custkey, c_name, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'Chunk', 'O' || o_orderkey, o_orderpriority, NULL, NULL, 'doc' || o_custkey FROM orders""")
table("chunks", """SELECT 'O' || o_orderkey AS chunk_id, 'doc' || o_custkey AS source_doc,
 'Order ' || o_orderpriority || ' with status ' || o_orderstatus || ' of customer ' || o_custkey AS content,
 CASE o_orderstatus WHEN 'F' THEN 'evidence' WHEN 'O' THEN 'guideline' ELSE 'criteria' END AS content_type FROM orders""")
table("eligibility", """SELECT 'S' || l_suppkey AS src, CASE WHEN l_returnflag = 'R' THEN 'notEligibleFor' ELSE 'eligibleFor' END AS predicate, 'P' || l_partkey AS dst,
 min(1 - l_discount) AS confidence, 'line ' || max(l_linenumber) AS clinical_context FROM lineitem GROUP BY 1, 2, 3""")
table("edges", """
SELECT src, predicate, dst, confidence, false AS is_hypothesis FROM eligibility
UNION ALL SELECT 'P' || p_partkey, 'definedIn', 'C' || (p_partkey * 7 % (SELECT 2 * max(c_custkey) + 2 FROM customer)), p_size / 50.0::DOUBLE, false FROM part
UNION ALL SELECT 'P' || p_partkey, 'overrides', 'P' || (p_partkey + 1), NULL, false FROM part
UNION ALL SELECT 'C' || c_custkey, 'refinesCategory', 'N' || c_nationkey, NULL, false FROM customer
UNION ALL SELECT 'C' || c_custkey, 'covers', 'S' || c_nationkey, NULL, false FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'refinesCategory', 'R' || n_regionkey, NULL, false FROM nation
UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'proposedEquivalence' ELSE 'proposedCorrelation' END, 'S' || n_nationkey, n_nationkey / 25.0::DOUBLE, n_nationkey % 4 = 0 FROM nation""", "eligibility")
table("live_edges", "SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)", "edges", "nodes")
table("mention_pairs", "SELECT DISTINCT 'O' || l_orderkey AS chunk_id, 'P' || l_partkey AS entity_id FROM lineitem")
_ids = "CASE score " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in zip(["3+", "2+", "1+", "0+", "0"], ["Score3Plus", "Score2Plus", "Score1Plus", "Score0Plus", "Score0"])) + " END"
table("specimen_edges", f"""
SELECT * FROM (SELECT 'SP' || case_id AS src, 'hasIHCScore' AS predicate, {_ids} AS dst FROM classified
UNION ALL SELECT 'SP' || case_id, 'hasISHGroup', CASE WHEN starts_with(ish_group, 'Group') THEN ish_group END FROM classified
UNION ALL SELECT 'SP' || case_id, 'classifiedAs', CASE WHEN classification <> 'UNKNOWN' THEN classification END FROM classified) WHERE dst IS NOT NULL""", "classified")
table("clinical_nodes", "SELECT type, id, label FROM v_seed_nodes UNION ALL SELECT 'Specimen', 'SP' || case_id, 'SP' || case_id FROM cases", "v_seed_nodes", "cases")
table("clinical_edges", "SELECT src, predicate, dst, confidence, is_hypothesis FROM v_seed_edges UNION ALL SELECT src, predicate, dst, NULL, false FROM specimen_edges",
      "v_seed_edges", "specimen_edges")

# ---- decision tables and path graph ------------------------------------------
_SC = ["Score3Plus", "Score2Plus", "Score1Plus", "Score0Plus", "Score0"]
table("decision_nodes", f"""
SELECT p || CASE WHEN j = 0 THEN '_ENTRY' ELSE '_N' || j END AS id, p || '_X' AS algorithm_id, p, j, 'is ' || p_name || '?' AS question,
 CASE WHEN j = 0 THEN 'entry' WHEN j % 4 = 1 THEN NULL ELSE 'decision' END AS type,
 CASE WHEN j > 12 THEN {pick(_SC, 'p_size')} END AS result, CASE WHEN j > 12 THEN {pick(v.CATEGORY_IDS, 'p_size')} END AS category,
 CASE WHEN j % 2 = 0 THEN p_name END AS label, p_name, p_size FROM (SELECT *, 'A' || (p_partkey // 16) AS p, p_partkey % 16 AS j FROM part)""")
table("emitted_edges", f"""
SELECT algorithm_id, p || '_ENTRY' AS from_id, p || '_N1' AS to_id, 'start' AS condition, 'begin' AS label, 0 AS step FROM decision_nodes WHERE j = 0
UNION ALL SELECT algorithm_id, p || '_N1', p || '_N2', 'YES', '', 0 FROM decision_nodes WHERE j = 1
UNION ALL SELECT algorithm_id, p || '_N15', p || '_N1', 'again', 'back', 0 FROM decision_nodes WHERE j = 15
UNION ALL SELECT algorithm_id, id, p || '_N1', 'start', '', 1 FROM decision_nodes WHERE j = 0
UNION ALL SELECT algorithm_id, id, p || '_N' || (2 * j), 'YES', '', 2 FROM decision_nodes WHERE j BETWEEN 1 AND 7
UNION ALL SELECT algorithm_id, id, CASE WHEN p_size % 3 = 0 THEN {pick(_SC, 'p_size')} ELSE {pick(v.CATEGORY_IDS, 'p_size')} END, 'YES', CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END, 2
 FROM decision_nodes WHERE j > 7 AND p_size % 3 <> 2
UNION ALL SELECT algorithm_id, id, p || '_N' || (2 * j + 1), 'NO', '', 3 FROM decision_nodes WHERE j BETWEEN 1 AND 7""", "decision_nodes")
table("merged_edges", "SELECT algorithm_id, from_id, to_id, condition, arg_max(label, step) AS label FROM emitted_edges GROUP BY ALL", "emitted_edges")
table("path_nodes", """
SELECT 'IHCScore' AS type, 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'ISHGroup', 'S' || s_suppkey FROM supplier
UNION ALL SELECT 'DiagnosticDecision', 'N' || n_nationkey FROM nation UNION ALL SELECT 'ClinicalCategory', 'R' || r_regionkey FROM region
UNION ALL SELECT 'Assay', 'A' || r_regionkey FROM region""")
table("path_edges", """
SELECT DISTINCT * FROM (SELECT 'C' || c_custkey AS src, 'implies' AS predicate, 'N' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'C' || c_custkey, 'requiresReflexTest', 'A' || (c_custkey % 5) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'C' || c_custkey, 'requiresReflexTest', 'N' || (c_nationkey * 7 % 25) FROM customer
UNION ALL SELECT 'A' || (s_suppkey % 5), 'resultsIn', 'S' || s_suppkey FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'leadsTo', 'N' || s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT 'N' || n_nationkey, 'leadsTo', 'N' || ((n_nationkey + 1) % 25) FROM nation
UNION ALL SELECT 'N' || n_nationkey, 'leadsTo', 'N' || (n_nationkey - n_nationkey % 2 + (1 - n_nationkey % 2)) FROM nation
UNION ALL SELECT 'N' || n_nationkey, 'leadsTo', 'R' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0)""")


def walk(name, starts, edges, hops):
    """Recursive CTE of edge-distinct paths: (start, nodes, preds, node, depth)."""
    return f"""{name} AS (SELECT id AS start, [id] AS nodes, []::VARCHAR[] AS preds, []::VARCHAR[] AS used, id AS node, 0 AS depth FROM ({starts})
 UNION ALL SELECT w.start, list_append(w.nodes, e.dst), list_append(w.preds, e.predicate), list_append(w.used, e.key), e.dst, w.depth + 1
 FROM {name} w JOIN ({edges}) e ON w.node = e.src WHERE w.depth < {hops} AND NOT list_contains(w.used, e.key))"""

# ---- retrieval ---------------------------------------------------------------
table("requests", """SELECT doc_id AS request_id, ['P' || doc_id, 'P' || (doc_id * 3 + 1), 'P' || (doc_id * 5 + 2)] AS entity_ids,
 ['CUSTOMER#' || lpad((doc_id % (SELECT max(c_custkey) + 1 FROM customer))::VARCHAR, 9, '0')] AS labels FROM documents""")
table("label_needles", """SELECT DISTINCT needle FROM (SELECT upper(unnest(string_split(p_name, ' '))) AS needle FROM part UNION ALL SELECT right(c_name, 4) FROM customer
 UNION ALL SELECT right(s_name, 2) FROM supplier UNION ALL SELECT '')""")
table("label_hits", """SELECT * FROM (SELECT n.needle, m.id, m.label, m.type AS node_type, row_number() OVER (PARTITION BY n.needle ORDER BY len(m.label), m.id, m.type) AS rank
 FROM label_needles n JOIN nodes m ON contains(lower(m.label), lower(n.needle)) WHERE m.type <> 'Chunk') WHERE rank <= 10""", "label_needles", "nodes")
table("answer_chunks", f"""SELECT 'a' || response_id AS chunk_id, response AS content, 'src' || lpad((response_id % 97)::VARCHAR, 2, '0') AS source_doc,
 {pick(['guideline', 'evidence', 'criteria', 'clinical_trial'], 'response_id')} AS content_type FROM responses""", "responses")


def _keywords():
    from ..operators.retrieval import EVIDENCE_TERMS
    cases = ", ".join(f"CASE WHEN contains(lower(query), '{t.lower()}') THEN '{t}' END" for t in EVIDENCE_TERMS)
    return f"(list_filter([{cases}], lambda x: x IS NOT NULL) || [left(query, 80)])[1:3]"


table("query_keywords", f"SELECT query_id, {_keywords()} AS kws FROM queries", "queries")
table("evidence_rows", """SELECT * FROM (SELECT q.query_id, q.kw_pos, c.chunk_id, c.source_doc, c.content_type, c.content AS context,
 row_number() OVER (PARTITION BY q.query_id, q.kw_pos ORDER BY c.source_doc, c.chunk_id) AS rank
 FROM (SELECT query_id, unnest(kws) AS kw, generate_subscripts(kws, 1) - 1 AS kw_pos FROM query_keywords) q JOIN answer_chunks c ON contains(lower(c.content), lower(q.kw))
 WHERE c.content_type IN ('guideline', 'clinical_trial', 'evidence')) WHERE rank <= 10""", "query_keywords", "answer_chunks")
table("context_rows", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY entity_id, node_type, relation NULLS FIRST, related_id NULLS FIRST, chunk_id NULLS FIRST) AS rank FROM (
 SELECT DISTINCT a.request_id, n.id AS entity_id, n.label, n.type AS node_type, e.predicate AS relation, e.dst AS related_id, e.label AS related_entity, e.confidence, c.chunk_id, c.content AS context, c.source_doc
 FROM (SELECT request_id, unnest(entity_ids) AS k, false AS lab FROM requests UNION ALL SELECT request_id, lower(unnest(labels)), true FROM requests) a
 JOIN nodes n ON (NOT a.lab AND n.id = a.k) OR (a.lab AND lower(n.label) = a.k)
 LEFT JOIN (SELECT e.*, x.label FROM edges e JOIN nodes x ON x.id = e.dst) e ON e.src = n.id
 LEFT JOIN (SELECT p.entity_id, c.* FROM mention_pairs p JOIN chunks c USING (chunk_id)) c ON c.entity_id = n.id)) WHERE rank <= 50""", "requests", "nodes", "edges", "mention_pairs", "chunks")
