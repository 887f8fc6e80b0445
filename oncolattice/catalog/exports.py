"""Registered queries: vectors, triples, sinks, streams, whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as k, rdf, rules, vectors as vec
from ..plans import answer as ans, build as bld
from ..session import shared_dir, spread
from ..sources import sinks, vocabulary as v
from ..streaming import graph as kept, ingest as stream, threads
from . import duck_inputs as d, graphs, inputs as i
from .registry import ORACLE, query, table, values
from .texts import _pg_chunks


def _new_dir(spark, name):
    """A folder of its own for one run, on storage all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/oncolattice-{name}-{uuid.uuid4().hex}"


# ---- vectors -----------------------------------------------------------------
def _vectors(spark, path):
    return i.read(spark, path, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _embedded(texts):
    """SQL for the nonzero entries of hashed embeddings, in ten-thousandths."""
    return f"""SELECT id, string_agg(slot || ':' || round(v / norm * 10000)::BIGINT, ' ' ORDER BY slot) AS entries FROM (
 SELECT id, slot, v, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM (
  SELECT id, code % 64 AS slot, sum(CASE WHEN code >= 2147483648 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM (
   SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS code FROM (SELECT id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM ({texts})) WHERE w <> '') GROUP BY 1, 2) WHERE v <> 0) GROUP BY 1"""


def _entries(done):
    at = F.transform("embedding", lambda x, k: F.when(x != 0, F.concat_ws(":", k.cast("string"), F.round(x.cast("double") * 10000).cast("bigint").cast("string"))))
    return done.select("id", F.array_join(F.array_compact(at), " ").alias("entries"))


@query("VEC1", _embedded("SELECT id, min(label) || ': ' AS text FROM nodes WHERE type <> 'Chunk' AND label IS NOT NULL AND id NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25) GROUP BY 1"), ("nodes",))
def vec1(spark, path):
    n = i.nodes(spark, path)
    stored = n.filter(F.try_element_at("props", F.lit("fda_approved")) == "true").select("id")
    return _entries(vec.embed_missing(vec.entity_texts(n), stored))


@query("VEC2", _embedded("SELECT chunk_id AS id, content AS text FROM chunks"), ("chunks",))
def vec2(spark, path):
    ch = i.chunks(spark, path)
    return _entries(vec.embed_missing(vec.chunk_texts(ch), ch.select(F.col("chunk_id").alias("id")).limit(0)))


@query("VEC3", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN embedding[64] ELSE embedding[1] END::DOUBLE AS first_value FROM embeddings")
def vec3(spark, path):
    old = _vectors(spark, path)
    new = old.filter(F.col("id") % 2 == 0).select("id", F.reverse("embedding").alias("embedding"), F.lit(1).alias("seq"))
    return vec.upsert_vectors(old, new.unionByName(old.select("id", "embedding", F.lit(0).alias("seq")))).select(
        "id", F.element_at("embedding", 1).cast("double").alias("first_value"))


_CENTRE = """q AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query("VEC4", """SELECT query_id, id, score, rank FROM (SELECT label::VARCHAR AS query_id, vec_id AS id, round(s, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(s, 12) DESC, vec_id) AS rank
 FROM (SELECT q.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.c) AS s FROM embeddings e, q)) WHERE rank <= 5""", (), _CENTRE)
def vec4(spark, path):
    """Nearest vectors to the mean vector of every label."""
    e = _vectors(spark, path)
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(F.col("label").cast("string").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))
    return vec.top_k(e, centres, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("VEC4_approx")
def vec4_approx(spark, path):
    """Nearest vectors to every vector whose id is divisible by 20, by buckets; tests measure recall against the exact form."""
    e = _vectors(spark, path)
    asked = e.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")
    return vec.approx_top_k(e, asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("VEC5", "SELECT vec_id AS id, len(embedding) - vec_id % 3 AS dim FROM embeddings WHERE vec_id % 3 <> 0")
def vec5(spark, path):
    e = _vectors(spark, path).withColumn("embedding", F.slice("embedding", F.lit(1), F.size("embedding") - (F.col("id") % 3).cast("int")))
    return vec.wrong_dimension(e, 64).select("id", F.size("embedding").cast("bigint").alias("dim"))


# ---- triples -----------------------------------------------------------------
B = rdf.NS["her2"]
table("rdf_nodes", """SELECT n.*, CASE WHEN starts_with(id, 'P') THEN substr(id, 2)::BIGINT END AS k FROM nodes n WHERE type <> 'Chunk'""", "nodes")
table("rdf_edges", "SELECT * FROM edges WHERE src IN (SELECT id FROM rdf_nodes) AND dst IN (SELECT id FROM rdf_nodes)", "edges", "rdf_nodes")
_T = "subject, predicate, object, object_kind, datatype"
table("t_decl", values([(B + rdf.CLASS_NAMES.get(c, c), p, o, kd, dt) for c in rdf.CLASSES for p, o, kd, dt in (
    (rdf.NS["rdf"] + "type", rdf.NS["owl"] + "Class", "uri", None), (rdf.NS["rdfs"] + "label", c, "literal", "string"))]
    + [(B + rdf.PREDICATE_NAMES.get(c, c), p, o, kd, dt) for c in rdf.PREDICATES for p, o, kd, dt in (
        (rdf.NS["rdf"] + "type", rdf.NS["owl"] + "ObjectProperty", "uri", None), (rdf.NS["rdfs"] + "label", c, "literal", "string"))]
    + [(B + "HER2_Positive", rdf.NS["owl"] + "disjointWith", B + "HER2_Negative", "uri", None)], _T.split(", ")))
table("t_type", f"SELECT '{B}' || id AS subject, '{rdf.NS['rdf']}type' AS predicate, '{B}' || type AS object, 'uri' AS object_kind, NULL::VARCHAR AS datatype FROM rdf_nodes", "rdf_nodes")
table("t_same", f"""SELECT '{B}' || id AS subject, '{rdf.NS['owl']}sameAs' AS predicate, '{rdf.NS['ncit']}' || substr(ncit_uri, 6) AS object, 'uri' AS object_kind, NULL::VARCHAR AS datatype FROM rdf_nodes WHERE starts_with(ncit_uri, 'NCIt:')
 UNION ALL SELECT '{B}' || id, '{rdf.NS['owl']}sameAs', '{rdf.NS['snomed']}' || substr(snomed_uri, 8), 'uri', NULL FROM rdf_nodes WHERE starts_with(snomed_uri, 'snomed:')""", "rdf_nodes")
table("t_prop", f"""SELECT '{B}' || id AS subject, '{B}' || p AS predicate, o AS object, 'literal' AS object_kind, t AS datatype FROM (
 SELECT id, 'label' AS p, label AS o, 'string' AS t FROM rdf_nodes WHERE label IS NOT NULL
 UNION ALL SELECT id, 'source_doc', source_doc, 'string' FROM rdf_nodes WHERE source_doc IS NOT NULL
 UNION ALL SELECT 'R' || r_regionkey, 'score', r_regionkey::VARCHAR, 'integer' FROM region UNION ALL SELECT 'N' || n_nationkey, 'group_number', n_nationkey::VARCHAR, 'integer' FROM nation
 UNION ALL SELECT 'P' || p_partkey, 'size', p_size::VARCHAR, 'integer' FROM part UNION ALL SELECT 'P' || p_partkey, 'brand', p_brand, 'string' FROM part
 UNION ALL SELECT 'P' || p_partkey, 'fda_approved', (p_size > 25)::VARCHAR, 'boolean' FROM part UNION ALL SELECT 'P' || p_partkey, 'price', p_retailprice::DECIMAL(12, 2)::VARCHAR, 'decimal' FROM part
 UNION ALL SELECT 'C' || c_custkey, 'year', (2000 + c_custkey % 26)::VARCHAR, 'integer' FROM customer UNION ALL SELECT 'C' || c_custkey, 'segment', c_mktsegment, 'string' FROM customer)""", "rdf_nodes")
_PU = f"CASE predicate WHEN 'refinesCategory' THEN '{rdf.NS['rdfs']}subClassOf' WHEN 'proposedEquivalence' THEN '{B}proposedCorrelation' ELSE '{B}' || predicate END"
table("t_edge", f"SELECT '{B}' || src AS subject, {_PU} AS predicate, '{B}' || dst AS object, 'uri' AS object_kind, NULL::VARCHAR AS datatype FROM rdf_edges", "rdf_edges")
_ST = f"'{B}' || src || '_' || predicate || '_' || '{B}' || dst || '_stmt'"
table("t_axiom", " UNION ALL ".join(f"SELECT {_ST} AS subject, '{p}' AS predicate, {o} AS object, '{kd}' AS object_kind, {dt} AS datatype FROM rdf_edges WHERE confidence IS NOT NULL" for p, o, kd, dt in (
    (rdf.NS["rdf"] + "type", f"'{rdf.NS['owl']}Axiom'", "uri", "NULL::VARCHAR"), (rdf.NS["owl"] + "annotatedSource", f"'{B}' || src", "uri", "NULL::VARCHAR"),
    (rdf.NS["owl"] + "annotatedProperty", _PU, "uri", "NULL::VARCHAR"), (rdf.NS["owl"] + "annotatedTarget", f"'{B}' || dst", "uri", "NULL::VARCHAR"),
    (B + "confidence", "confidence::VARCHAR", "literal", "'decimal'"))), "rdf_edges")
_ALL = ("t_decl", "t_type", "t_same", "t_prop", "t_edge", "t_axiom")
table("triples", " UNION ".join(f"SELECT {_T} FROM {t}" for t in _ALL), *_ALL)


def _n(spark, path):
    from ..operators.graph import export_nodes
    return export_nodes(i.nodes(spark, path))


def _e(spark, path):
    from ..operators.graph import export_edges
    return export_edges(i.edges(spark, path), i.nodes(spark, path))


def _triples(spark, path):
    return rdf.triples(i.nodes(spark, path), i.edges(spark, path))


@query("RDF1", f"SELECT DISTINCT name, '{B}' || replace(replace(replace(name, ' ', '_'), '/', '_'), ':', '_') AS uri FROM (SELECT p_name || ' a/b:' || p_brand AS name FROM part)")
def rdf1(spark, path):
    names = i.read(spark, path, "part").select(F.concat("p_name", F.lit(" a/b:"), "p_brand").alias("name")).distinct()
    return names.select("name", rdf.node_uri(F.col("name"), B).alias("uri"))


@query("RDF2", f"SELECT d.subject, count(*) AS used FROM t_decl d JOIN t_type t ON t.object = d.subject WHERE d.predicate = '{rdf.NS['rdf']}type' GROUP BY 1", ("t_decl", "t_type"))
def rdf2(spark, path):
    """Declared classes with the number of nodes that use them."""
    used = rdf.type_triples(_n(spark, path)).groupBy(F.col("object").alias("subject")).agg(F.count("*").alias("used"))
    declared = rdf.declarations(spark).filter(F.col("predicate") == rdf.NS["rdf"] + "type").select("subject").distinct()
    return used.join(F.broadcast(declared), "subject", "left_semi")


query("RDF3", f"SELECT {_T} FROM t_type", ("t_type",))(lambda spark, path: rdf.type_triples(_n(spark, path)))
query("RDF4", f"SELECT {_T} FROM t_same", ("t_same",))(lambda spark, path: rdf.same_as(_n(spark, path)))
query("RDF5", f"SELECT {_T} FROM t_prop", ("t_prop",))(lambda spark, path: rdf.property_triples(_n(spark, path)))
query("RDF6", f"SELECT {_T} FROM t_edge", ("t_edge",))(lambda spark, path: rdf.edge_triples(_e(spark, path)))
query("RDF7", f"SELECT {_T} FROM t_axiom", ("t_axiom",))(lambda spark, path: rdf.axiom_triples(_e(spark, path)))


@query("RDF8", f"SELECT count(*) AS conflicting FROM (SELECT src FROM specimen_edges WHERE dst IN ('HER2_Positive', 'HER2_Negative') AND predicate = 'classifiedAs' GROUP BY 1 HAVING count(DISTINCT dst) > 1)", ("specimen_edges",))
def rdf8(spark, path):
    """Specimens in both of two classes declared disjoint."""
    pairs = rdf.declarations(spark).filter(F.col("predicate") == rdf.NS["owl"] + "disjointWith").select("subject", "object")
    _, links = i.specimens(spark, path)
    at = links.filter(F.col("predicate") == "classifiedAs").select("src", rdf.node_uri(F.col("dst"), B).alias("subject"))
    left = at.join(F.broadcast(pairs), "subject").select("src", F.col("object").alias("other"))
    return left.join(at.select("src", F.col("subject").alias("other")), ["src", "other"]).select("src").distinct().agg(F.count("*").alias("conflicting"))


query("RDF9", f"SELECT {_T} FROM triples", ("triples",))(_triples)


@query("RDF9_count", "SELECT count(*) AS triples FROM triples", ("triples",))
def rdf9_count(spark, path):
    return _triples(spark, path).agg(F.count("*").alias("triples"))


# ---- sinks -------------------------------------------------------------------
_LINE = f"""'<' || subject || '> <' || predicate || '> ' || CASE WHEN object_kind = 'uri' THEN '<' || object || '>' ELSE '"' || object || '"' || CASE WHEN datatype <> 'string' THEN '^^<{rdf.NS['xsd']}' || datatype || '>' ELSE '' END END || ' .'"""


@query("SNK1", f"SELECT {_LINE} AS value FROM triples", ("triples",))
def snk1(spark, path):
    out = _new_dir(spark, "triples")
    sinks.write_ntriples(_triples(spark, path), out)
    return spark.read.text(out)


@query("SNK2", """SELECT subject, predicate, object, object_kind, datatype FROM triples""", ("triples",))
def snk2(spark, path):
    """Written JSON-LD read back as triples."""
    out = _new_dir(spark, "jsonld")
    sinks.write_jsonld(_triples(spark, path), out)
    back = sinks.read_jsonld(spark, out).select(F.from_json("value", "map<string,string>").alias("m"))
    entry = back.select(F.col("m")["@id"].alias("subject"), F.explode(F.map_filter("m", lambda key, _: key != "@id")).alias("predicate", "v"))
    value = entry.select("subject", "predicate", F.explode(F.from_json("v", "array<struct<`@id`:string,`@value`:string,`@type`:string>>")).alias("o"))
    at = lambda name: F.col(f"o.`{name}`")
    literal = at("@value").isNotNull()
    return value.select("subject", "predicate", F.coalesce(at("@value"), at("@id")).alias("object"), F.when(literal, "literal").otherwise("uri").alias("object_kind"),
                        F.when(literal, F.coalesce(F.substring_index(at("@type"), "#", -1), F.lit("string"))).alias("datatype"))


_REPORT = ORACLE["VAL15"]


@query("SNK3", f"""SELECT (SELECT count(*) FROM chunks) AS chunks_processed, (SELECT count(*) FROM res_winner) AS entities_resolved, (SELECT count(*) FROM local_relations) AS relations_resolved,
 (SELECT count(*) FROM an) AS total_nodes, (SELECT count(*) FROM ae) AS total_relations, r.total, r.passed, r.critical, 12.3::DOUBLE AS elapsed_seconds, '20260102_030405' AS run_suffix
 FROM (SELECT count(*) AS total, count(CASE WHEN valid THEN 1 END) AS passed, count(CASE WHEN NOT valid AND severity = 'CRITICAL' THEN 1 END) AS critical FROM ({graphs._RULE_SQL})) r""",
       (*graphs._USE, "chunks", "res_winner", "local_relations"), graphs._CTE)
def snk3(spark, path):
    n, e = graphs._both(spark, path)
    out = _new_dir(spark, "record")
    start = F.lit("2026-01-02 03:04:05").cast("timestamp")
    from ..operators.resolution import dedupe
    record = sinks.run_record(i.chunks(spark, path), dedupe(graphs._resolved(spark, path)), i.local_relations(spark, path), n, e,
                              rules.report(rules.run(n, e)), start, start + F.expr("interval 12 seconds 300 milliseconds"))
    sinks.write_run_record(record, out)
    names = ["chunks_processed", "entities_resolved", "relations_resolved", "total_nodes", "total_relations", "total", "passed", "critical"]
    schema = ", ".join(f"{c} bigint" for c in names) + ", elapsed_seconds double, run_suffix string"
    return spark.read.schema(schema).json(out)


@query("SNK4", "SELECT strftime(ts, '%Y%m%d_%H%M%S') AS run_suffix, count(*) AS n FROM events GROUP BY 1")
def snk4(spark, path):
    return i.read(spark, path, "events").groupBy(sinks.run_suffix(F.col("ts")).alias("run_suffix")).agg(F.count("*").alias("n"))


@query("SNK5", "SELECT 'nodes' AS tab, type AS part, id AS key, label AS value FROM nodes UNION ALL SELECT 'edges', predicate, src || '>' || dst, is_hypothesis::VARCHAR FROM edges", ("nodes", "edges"))
def snk5(spark, path):
    run = sinks.RunTables(spark, _new_dir(spark, "run"))
    n, e = run.write("nodes", i.nodes(spark, path)), run.write("edges", i.edges(spark, path))
    label = F.col("label")
    return (n.select(F.lit("nodes").alias("tab"), F.col("type").alias("part"), F.col("id").alias("key"), label.alias("value"))
            .unionByName(e.select(F.lit("edges").alias("tab"), F.col("predicate").alias("part"), F.concat_ws(">", "src", "dst").alias("key"),
                                  F.col("is_hypothesis").cast("string").alias("value"))))


# ---- streams -----------------------------------------------------------------
@query("STR1", "SELECT chunk_id, source_doc, section, content FROM pg_chunks", ("page_rows",), _pg_chunks)
def str1(spark, path):
    """Two disjoint halves of the documents and the first once more, by three streams, the last after a fold."""
    root = _new_dir(spark, "ingest")

    def pages(docs, part):
        docs = docs.filter(F.col("doc_id") % 2 == part)
        return k.chunk_pages(spread(docs).select(F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_doc"),
                                         F.posexplode(F.split("text", "\n")).alias("page_num", "text")).withColumn("page_num", F.col("page_num") + 1))
    for turn, (part, folder) in enumerate([(0, "first"), (1, "first"), (0, "folded")]):
        if turn == 2:
            stream.fold(spark, f"{root}/first", f"{root}/folded")
        docs = stream.parquet_stream(spark, path, "documents.parquet", f"{path}/documents.parquet")
        stream.ingest(docs, lambda df, part=part: pages(df, part), f"{root}/{folder}", f"{root}/offsets-{turn}")
    return stream.ingested(spark, f"{root}/folded").select("chunk_id", "source_doc", "section", "content")


@query("STR1_graph", """SELECT src, predicate, dst, confidence FROM (SELECT 'S' || l_suppkey AS src, CASE WHEN l_returnflag = 'R' THEN 'notEligibleFor' ELSE 'eligibleFor' END AS predicate,
 'P' || l_partkey AS dst, arg_max(1 - l_discount, (l_orderkey % 3) * 1000000000000000 + (l_orderkey * 100 + l_linenumber) * 1000 + round(l_discount * 100)::BIGINT) AS confidence FROM lineitem GROUP BY 1, 2, 3)""")
def str1_graph(spark, path):
    """Line items as edges in three arrivals, the last taken in twice as after a failure; their ends arrive in the second."""
    root = _new_dir(spark, "graph")
    tables = kept.GraphTables(spark, f"{root}/tables", 8)
    agents = i.read(spark, path, "part").select(F.lit("TherapeuticAgent").alias("type"), i._id("P", "p_partkey").alias("id"), F.col("p_name").alias("label"))
    sources = i.read(spark, path, "supplier").select(F.lit("Guideline").alias("type"), i._id("S", "s_suppkey").alias("id"), F.col("s_name").alias("label"))
    ends = agents.unionByName(sources).withColumn("props", F.create_map().cast("map<string,string>"))
    no_mentions = spark.createDataFrame([], kept.MENTIONS)

    def changes(batch, turn):
        mine = batch.filter(F.col("l_orderkey") % 3 == turn)
        place = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000 + F.round(F.col("l_discount") * 100).cast("bigint")
        edges = mine.select(i._id("S", "l_suppkey").alias("src"), F.when(F.col("l_returnflag") == "R", "notEligibleFor").otherwise("eligibleFor").alias("predicate"),
                            i._id("P", "l_partkey").alias("dst"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("algorithm_id"),
                            (1 - F.col("l_discount")).alias("confidence"), F.lit(False).alias("is_hypothesis"), F.create_map().cast("map<string,string>").alias("props"),
                            F.lpad(place.cast("string"), 20, "0").alias("place"))
        return ends if turn == 1 else ends.limit(0), edges, no_mentions
    for k_, turn in enumerate([0, 1, 2, 2]):
        arrived = stream.parquet_stream(spark, path, "lineitem.parquet", f"{path}/lineitem.parquet")
        kept.follow(arrived, lambda df, _, turn=turn: changes(df, turn), tables, f"{root}/offsets-{k_}")
    return tables.edges().select("src", "predicate", "dst", "confidence")


table("thread_items", "SELECT thread_id, query_id * 10 + seq AS seq, agent FROM agent_results", "agent_results")


@query("STR2", """SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq, agent) AS item_no, seq, agent, row_number() OVER (PARTITION BY thread_id, agent ORDER BY seq) = 1 AS first_run FROM thread_items""", ("thread_items",))
def str2(spark, path):
    """Conversations streamed through the thread state."""
    root = _new_dir(spark, "threads")
    src = stream.parquet_stream(spark, path, "conversations.parquet", f"{path}/conversations.parquet")
    from ..operators.routing import keyword_route
    from .inputs import QUERY_PHRASES, pick
    key = F.col("conv_id") + F.col("turn")
    routed = src.filter(F.col("role") == "user").select(
        F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("thread_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
        F.posexplode(keyword_route(F.concat_ws(" ", "text", pick(QUERY_PHRASES, key)), key % 5 == 0)).alias("pos", "agent"))
    items = routed.select("thread_id", (F.col("query_id") * 10 + F.col("pos")).alias("seq"), "agent")
    threads.run_threads(items, f"{root}/out", f"{root}/offsets")
    return spark.read.schema(threads.ITEMS).parquet(f"{root}/out").select("thread_id", "item_no", "seq", "agent", "first_run")


@query("STR2_fold", """SELECT thread_id, array_to_string(list(agent ORDER BY s), ',') AS ran, sum(n)::BIGINT AS items FROM (SELECT thread_id, agent, min(seq) AS s, count(*) AS n FROM thread_items GROUP BY 1, 2) GROUP BY 1""", ("thread_items",))
def str2_fold(spark, path):
    r = i.agent_results(spark, path).select("thread_id", (F.col("query_id") * 10 + F.col("seq")).alias("seq"), "agent")
    return threads.fold_threads(r).select("thread_id", F.array_join("ran", ",").alias("ran"), "items")


# ---- whole runs ----------------------------------------------------------------
@query("build")
def build(spark, path):
    """Conversations and pages through all stages: rows of every table written, nodes and edges by kind."""
    run = sinks.RunTables(spark, _new_dir(spark, "build"))
    out = bld.build(run, i.markdown_docs(spark, path), i.page_rows(spark, path), "2026-01-01T00:00:00")
    from ..operators.graph import load_counts
    other = [out[t].select(F.lit("table").alias("part"), F.lit(t).alias("name")).groupBy("part", "name").agg(F.count("*").alias("n"))
             for t in ("chunks", "mentions", "triples", "new_vectors")]
    rows = load_counts(out["nodes"], out["edges"])
    for part in other:
        rows = rows.unionByName(part)
    return rows


@query("answer", """SELECT r.query_id, array_to_string(p, ',') AS agents_invoked, CASE WHEN list_contains(p, 'diagnostic') THEN CASE coalesce(c.confidence, 'LOW') WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.6 ELSE 0.3 END ELSE 0.5 END::DOUBLE AS confidence,
 list_contains(p, 'validation') AND coalesce(crit, 0) > 0 AS needs_review
FROM (SELECT query_id, list_filter(target_agents, lambda a: NOT list_contains(ran, a))[1:3 - iteration] AS p, CASE WHEN has_case THEN query_id % (SELECT max(case_id) + 1 FROM cases) END AS case_id FROM routes) r
LEFT JOIN classified c ON c.case_id = r.case_id LEFT JOIN (SELECT case_id, count(*) AS crit FROM (SELECT case_id FROM rule_issues WHERE severity = 'CRITICAL' UNION ALL SELECT case_id FROM conflicts) GROUP BY 1) x ON x.case_id = r.case_id""",
       ("routes", "classified", "rule_issues", "conflicts", "cases"))
def answer(spark, path):
    n, e = i.clinical_graph(spark, path)
    q = i.queries(spark, path).withColumn("case_id", F.when(F.col("has_case"), F.col("query_id") % (i.cases(spark, path).agg(F.max("case_id")).first()[0] + 1)))
    return ans.answer(q, i.cases(spark, path), n, e, i.answer_chunks(spark, path), i.correlations(spark, path), max_passes=3, keyword_count=3, keyword_chars=80).drop("answer")
