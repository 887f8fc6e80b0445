"""Clinical inputs derived, row by row, from the given tables.

The given tables hold no clinical data, so each input here maps whole source
tables onto the schema an operator expects; ``duck_inputs`` states the same
mappings in SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import pick, unnest
from ..operators.cases import ish_group
from ..session import dealt, spread

CASE_SCORES = ["3+", "2+", "1+", "0+", "0", "Score2Plus", "IHC3Plus", "bad_value"]
CASE_CATEGORIES = ["HER2_Positive", "HER2-Low", "HER2_Null", "HER2_Equivocal", "HER2-Ultralow", "HER2_Negative", "Other"]
QUERY_PHRASES = ["", "Please classify this biopsy", "Is T-DXd approved in the trial?", "Why is it equivocal?",
                 "Check that it is consistent", "Explain the pathway and check the guideline", "IHC and ISH for HER2-low by ASCO"]
ROUTER_RAW = ['["diagnostic"]', 'Use ["evidence","validation"] now', '<think>["validation"]</think>["explanation"]',
              "not json", '["unknown"]', "[broken", '["a"] then ["diagnostic","evidence","explanation","validation"]',
              '["diagnostic", oops]', '["evidence"] and [1, 2]']
RAN = ["", "diagnostic", "diagnostic,evidence", "validation"]
RESPONSE_PHRASES = [
    "", "HER2-Negative tumour, IHC 5+ and IHC 2+.", "Give Kadcyla or T-DM1 or kadcyla, always.",
    "IHC 3+ but HER2 Low here.", "T-DXd is an option without exception.",
    "It requires care, must wait, must repeat, is positive and is recommended.",
    "Enhertu and neratinib per NCCN guideline, IHC 10 and IHC 0.", "T-DXd, not eligible; never guaranteed.",
    "HER2 negative, IHC 7, Kadcyla, IHC 9+."]
RESPONSE_SCORES = ["3+", "0", "2+", "1+", "0+"]


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_texts(spark, path, name):
    """Table of texts, spread over the cores when it is small."""
    return spread(read(spark, path, name))


def cases(spark, path):
    """Events as cases."""
    e = F.col("event_id")
    ratio, signals = F.col("value") / 5.0, (F.col("user_id") % 80) / 10.0
    return read(spark, path, "events").select(
        e.alias("case_id"),
        pick(CASE_SCORES, e).alias("ihc_score"),
        F.when(e % 3 == 0, F.lit(None)).when(e % 11 == 0, "5").when(e % 13 == 0, "")
        .otherwise(ish_group(ratio, signals)).alias("ish_group"),
        ratio.alias("ish_ratio"), signals.alias("signals_per_cell"),
        F.when(e % 5 != 0, (130 + e % 80) / 100.0).alias("fractal_d0"),
        pick(CASE_CATEGORIES, F.col("user_id")).alias("category"))


def correlations(spark, path):
    """Nations as metric-category correlations with a range."""
    from ..sources.vocabulary import CATEGORY_IDS
    n = F.col("n_nationkey")
    return read(spark, path, "nation").select(
        pick(CATEGORY_IDS, n).alias("category_id"), F.col("n_name").alias("metric_label"),
        ((100 + n * 3) / 100.0).alias("d0_low"), ((140 + n * 2) / 100.0).alias("d0_high"))


def _turns(spark, path, role):
    return read(spark, path, "conversations").filter(F.col("role") == role).withColumn(
        "k", F.col("conv_id") + F.col("turn"))


def queries(spark, path):
    """User turns as queries with router output."""
    return _turns(spark, path, "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("thread_id"),
        F.concat_ws(" ", "text", pick(QUERY_PHRASES, F.col("k"))).alias("query"),
        (F.col("k") % 5 == 0).alias("has_case"),
        pick(ROUTER_RAW, F.col("conv_id") * 3 + F.col("turn")).alias("router_raw"),
        F.filter(F.split(pick(RAN, F.col("conv_id")), ","), lambda a: a != "").alias("ran"),
        (F.col("conv_id") % 4).cast("int").alias("iteration"))


def responses(spark, path):
    """Assistant turns as generated answers."""
    return _turns(spark, path, "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("response_id"),
        F.concat_ws(" ", "text", pick(RESPONSE_PHRASES, F.col("conv_id") * 7 + F.col("turn"))).alias("response"),
        pick(RESPONSE_SCORES, F.col("k")).alias("ihc_score"),
        F.when(F.col("k") % 2 == 0, "Group1").alias("ish_group"),
        F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("kadcyla"))).otherwise(F.array().cast("array<string>")).alias("context_labels"),
        (F.col("conv_id") % 6 != 0).alias("has_case"))


def agent_results(spark, path):
    """Results of the agents that each query is routed to by keyword."""
    from ..operators.routing import keyword_route
    q = queries(spark, path)
    return unnest(q, ["query_id", "thread_id"], keyword_route(F.col("query"), F.col("has_case")), "agent", "seq").select(
        "query_id", "thread_id", "seq", "agent",
        pick(["HIGH", "MEDIUM", "LOW", "odd", ""], F.col("query_id") + F.col("seq")).alias("confidence"),
        F.when(F.col("agent") == "validation", F.col("query_id") % 3).alias("critical_count"),
        F.concat(F.lit("text of "), F.col("agent"), F.lit(" for "), F.col("query_id").cast("string")).alias("narrative"))


MD_EXTRAS = [
    "",
    "```python\nx = 1  # owl:Class\ny = 2\n```\nafter the code block",
    "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\ntail of the table",
    "NODO-1:: is the staining complete and intense in more than ten percent of cells\nACCIÓN:: if yes then score 3+ and stop\nif no go on to the next node\n",
    "```\nsame block\n```\nbetween\n```\nsame block\n```",
    "\n## Adjacent A\n## Adjacent B\nlost under parity, IHC 2+ should be kept by the guideline only when text is kept\n",
    "COMENTARIO-A:: short\n",
]


def markdown_docs(spark, path):
    """Conversations as Markdown documents: a heading per turn, blocks by turn."""
    lead = F.when(F.col("conv_id") % 3 == 0, "# Conversation\nwords that parity drops\n").otherwise(
        F.concat(F.lit("Opening words of conversation number "), F.col("conv_id").cast("string"), F.lit(" that are long enough for a chunk.\n")))
    block = F.concat(F.lit("\n## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"),
                     pick(MD_EXTRAS, F.col("conv_id") + F.col("turn")), F.lit("\n"))
    return (read(spark, path, "conversations").groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "").alias("body"))
            .select(F.concat(F.lit("conv_"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(".md")).alias("source_doc"),
                    F.concat(lead, "body").alias("text")))


def page_rows(spark, path):
    """Documents as page texts: a page per line."""
    return read_texts(spark, path, "documents").select(
        F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_doc"),
        F.posexplode(F.split("text", "\n")).alias("page_num", "text")).withColumn("page_num", F.col("page_num") + 1)


EXT_LABELS = ["HER2-Low 1", "Ana García", "Python SDK", "T-DXd", "IHC 2+", "Regional node", "Kafka", "Trastuzumab Deruxtecan",
              "Ki67", "Hospital 12 de Octubre", "Ratio > 2.0 (CEP17)", "Group 3/4", "Pipette 2"]
EXT_TYPES = ["ClinicalCategory"] * 5 + ["Gene"] + ["IHCScore"] * 10
EXT_CONF = [',"confidence":0.9'] * 7 + [',"confidence":null', ',"confidence":"0.9"', ',"confidence":"x"', ',"confidence":1.5',
                                         ',"confidence":0.6', "", ',"confidence":true', ',"confidence":0', ',"confidence":0.59']
EXT_PREDICATES = ["implies", "implies", "eligibleFor", "definedIn", "implies", "implies", "causes", "leadsTo"]
EXT_REL_CONF = ["0.5", "0.49", "0.7", "1", "\"0.8\""]
EXT_DEFS = [',"definition":"first"', ',"definition":"second"', "", ',"definition":null', ',"definition":5']
EXT_URIS = ["", ',"candidate_uri":"NCIt:C99999"', ',"candidate_uri":null', ',"candidate_uri":"odd:1"']


def raw_extractions(spark, path):
    """Events as raw extractor answers, well-formed and not."""
    e = F.col("event_id")
    first = F.concat(F.when(e % 17 == 10, "").otherwise('"id":"e1",'), F.lit('"label":"'), pick(EXT_LABELS, e), F.lit('","type":"'),
                     pick(EXT_TYPES, e), F.lit('"'), pick(EXT_CONF, e), pick(EXT_DEFS, e), pick(EXT_URIS, F.floor(e / 3)))
    second = F.concat(F.lit('"id":"e2"'), F.when(e % 19 == 3, "").otherwise(F.concat(F.lit(',"label":"'), pick(EXT_LABELS, e * 5 + 2), F.lit('"'))),
                      F.lit(',"type":"Assay","confidence":'), (F.lit(50) + e % 50).cast("string"), F.lit('e-2'), pick(EXT_DEFS, e + 1))
    relation = F.concat(F.lit('"subject_id":"e1","predicate":"'), pick(EXT_PREDICATES, e), F.lit('","object_id":"'),
                        F.when(e % 13 == 11, "e9").otherwise("e2"), F.lit('","confidence":'), pick(EXT_REL_CONF, e), F.lit(',"evidence":"seen"'))
    body = F.concat(F.lit('{"entities":[{'), first, F.lit("},{"), second, F.lit('}],"relations":[{'), relation, F.lit("}]}"))
    raw = (F.when(e % 16 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(e % 16 == 2, F.concat(F.lit("<think>is it {\n} so</think>\n"), body))
           .when(e % 16 == 3, F.substring(body, F.lit(1), F.length(body) - 3))
           .when(e % 16 == 4, F.concat(F.lit("["), body, F.lit("]"))).when(e % 16 == 14, "").otherwise(body))
    return dealt(read(spark, path, "events").select("event_id"), "event_id", rows=50_000).select(  # costly rows of a narrow table, which has few splits
        F.concat(F.lit("c"), e.cast("string")).alias("chunk_id"), F.concat(F.lit("S"), (e % 9).cast("string")).alias("section"), raw.alias("raw"))


RES_LABELS = ["HER2-Positive", "IHC 2+", "T-DXd", "ASCO-CAP-2023", "CAP  2025", "her2-low", "Immunohistochemistry", "Unknown entity XYZ123",
              "HER2 positve", "Ratio > 2.0 (CEP17) 10%", "Rakha 2026", "ISH grup 3", "Perzutumab", "lacunarity", "In Situ Hybridization",
              "Her2 Null", "Group 3/4 - mixed", "daisy", "DB-06", "Trastuzumab Deruxtecan-x"]
RES_URIS = [None, None, None, "NCIt:C99999", None, "snomed:1", "odd:7", "her2:own", None]
RES_DEFS = ["first", "second", "", None, "first | second", "second"]


def entities_to_resolve(spark, path):
    """Events as extracted entities, eight to a chunk."""
    e = F.col("event_id")
    return read(spark, path, "events").select(
        F.concat(F.lit("c"), F.floor(e / 8).cast("string")).alias("chunk_id"), (e % 8).cast("int").alias("pos"),
        F.concat(F.lit("e"), (e % 7).cast("string")).alias("local_id"), pick(RES_LABELS, F.col("user_id") + F.floor(e / 3)).alias("label"),
        pick(["ClinicalCategory", "Assay", "TherapeuticAgent"], e).alias("type"), pick(RES_DEFS, F.floor(e / 2)).alias("definition"),
        F.lit(None).cast("string").alias("source_quote"), pick(RES_URIS, e).alias("candidate_uri"),
        ((e * 37 % 5 + 5) / 10.0).alias("confidence"))


def local_relations(spark, path):
    """Events as relations between answer-local ids."""
    e = F.col("event_id")
    return read(spark, path, "events").select(
        F.concat(F.lit("c"), F.floor(e / 8).cast("string")).alias("chunk_id"), F.concat(F.lit("e"), (e % 7).cast("string")).alias("subject_id"),
        pick(["implies", "definedIn"], e).alias("predicate"), F.concat(F.lit("e"), (e % 11).cast("string")).alias("object_id"),
        (e % 10 / 10.0).alias("confidence"), F.lit(None).cast("string").alias("evidence"))


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _quoted(col):
    return F.concat(F.lit('"'), col, F.lit('"'))


def _nodes(df, kind, node_id, label, **props):
    from ..functions.props import props_map
    return df.select(F.lit(kind).alias("type"), node_id.alias("id"), label.alias("label"), props_map(**props).alias("props"))


def nodes(spark, path):
    """Star-schema rows as typed nodes."""
    t = lambda name: read(spark, path, name)
    out = _nodes(t("region"), "IHCScore", _id("R", "r_regionkey"), F.col("r_name"), score=F.col("r_regionkey"))
    more = [
        _nodes(t("nation"), "ISHGroup", _id("N", "n_nationkey"), F.col("n_name"), group_number=F.col("n_nationkey")),
        _nodes(t("supplier"), "ClinicalCategory", _id("S", "s_suppkey"), F.col("s_name"), source_doc=F.lit('"ontology:seed"')),
        _nodes(t("part"), "TherapeuticAgent", _id("P", "p_partkey"), F.col("p_name"), size=F.col("p_size"), brand=_quoted(F.col("p_brand")),
               fda_approved=(F.col("p_size") > 25), price=F.col("p_retailprice").cast("decimal(12,2)"),
               ncit_uri=F.when(F.col("p_partkey") % 3 == 0, _quoted(_id("NCIt:C", "p_partkey"))),
               snomed_uri=F.when(F.col("p_partkey") % 5 == 0, _quoted(_id("snomed:", "p_partkey"))),
               source_doc=_quoted(_id("O", "p_partkey"))),
        _nodes(t("customer"), "Guideline", _id("C", "c_custkey"), F.col("c_name"), year=2000 + F.col("c_custkey") % 26,
               segment=_quoted(F.col("c_mktsegment"))),
        _nodes(t("orders"), "Chunk", _id("O", "o_orderkey"), F.col("o_orderpriority"), source_doc=_quoted(_id("doc", "o_custkey"))),
    ]
    for part in more:
        out = out.unionByName(part)
    return out


def chunks(spark, path):
    """Orders as stored chunks."""
    return read(spark, path, "orders").select(
        _id("O", "o_orderkey").alias("chunk_id"), _id("doc", "o_custkey").alias("source_doc"),
        F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" with status "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey").cast("string")).alias("content"),
        F.when(F.col("o_orderstatus") == "F", "evidence").when(F.col("o_orderstatus") == "O", "guideline").otherwise("criteria").alias("content_type"))


def _edges(df, src, predicate, dst, confidence=None, hypothesis=None, **props):
    from ..functions.props import props_map
    none = F.lit(None).cast("string")
    return df.select(src.alias("src"), predicate.alias("predicate"), dst.alias("dst"), none.alias("condition"), none.alias("algorithm_id"),
                     (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
                     (F.lit(False) if hypothesis is None else hypothesis).alias("is_hypothesis"),
                     (props_map(**props) if props else F.create_map().cast("map<string,string>")).alias("props"))


def eligibility(spark, path):
    """Eligibility edges, one per key."""
    li = dealt(read(spark, path, "lineitem"), "l_suppkey", "l_partkey")
    best = li.groupBy("l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "notEligibleFor").otherwise("eligibleFor").alias("predicate")).agg(
        F.min(1 - F.col("l_discount")).alias("confidence"), F.max("l_linenumber").alias("line"))
    return _edges(best, _id("S", "l_suppkey"), F.col("predicate"), _id("P", "l_partkey"), F.col("confidence"),
                  clinical_context=_quoted(_id("line ", "line")))


def edges(spark, path):
    """Edges of the derived graph; orders point at customers, some of them missing."""
    t = lambda name: read(spark, path, name)
    out = eligibility(spark, path)
    for part in (
        _edges(t("part"), _id("P", "p_partkey"), F.lit("definedIn"), F.concat(F.lit("C"), (F.col("p_partkey") * 7 % (2 * key_range(spark, path, "customer", "c_custkey"))).cast("string")), (F.col("p_size") / 50.0)),
        _edges(t("part"), _id("P", "p_partkey"), F.lit("overrides"), F.concat(F.lit("P"), (F.col("p_partkey") + 1).cast("string"))),
        _edges(t("customer"), _id("C", "c_custkey"), F.lit("refinesCategory"), _id("N", "c_nationkey")),
        _edges(t("customer"), _id("C", "c_custkey"), F.lit("covers"), _id("S", "c_nationkey")),
        _edges(t("nation"), _id("N", "n_nationkey"), F.lit("refinesCategory"), _id("R", "n_regionkey")),
        _edges(t("nation"), _id("N", "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "proposedEquivalence").otherwise("proposedCorrelation"),
               _id("S", "n_nationkey"), F.col("n_nationkey") / 25.0, F.col("n_nationkey") % 4 == 0),
    ):
        out = out.unionByName(part)
    return out


def mention_pairs(spark, path):
    """Line items as mentions of parts in orders."""
    return read(spark, path, "lineitem").select(_id("O", "l_orderkey").alias("chunk_id"), _id("P", "l_partkey").alias("entity_id")).distinct()


def specimens(spark, path):
    """Cases as specimen nodes with links to score, group and category; both tables."""
    from ..operators.cases import SCORE_IDS, SCORES, classify
    c = classify(cases(spark, path))
    sp = F.concat(F.lit("SP"), F.col("case_id").cast("string"))
    score = F.try_element_at(F.create_map(*[F.lit(x) for p in zip(SCORES, SCORE_IDS) for x in p]), F.col("score"))
    node = c.select(F.lit("Specimen").alias("type"), sp.alias("id"), sp.alias("label"), F.create_map().cast("map<string,string>").alias("props"))
    links = c.select(sp.alias("src"), F.explode(F.array_compact(F.array(
        F.when(score.isNotNull(), F.struct(F.lit("hasIHCScore").alias("p"), score.alias("d"))),
        F.when(F.col("ish_group").startswith("Group"), F.struct(F.lit("hasISHGroup").alias("p"), F.col("ish_group").alias("d"))),
        F.when(F.col("classification") != "UNKNOWN", F.struct(F.lit("classifiedAs").alias("p"), F.col("classification").alias("d")))))).alias("l"))
    return node, _edges(links, F.col("src"), F.col("l.p"), F.col("l.d"))


def clinical_graph(spark, path):
    """Seed graph together with the specimens of all cases."""
    from ..sources import vocabulary as v
    node, link = specimens(spark, path)
    return v.seed_entities_df(spark).unionByName(node), v.seed_relations_df(spark).unionByName(link)


def decision_nodes(spark, path):
    """Parts as decision tables: sixteen nodes to an algorithm, a binary tree with leaves."""
    from ..operators.cases import SCORE_IDS
    from ..sources.vocabulary import CATEGORY_IDS
    k = F.col("p_partkey")
    j = (k % 16).cast("int")
    prefix = F.concat(F.lit("A"), F.floor(k / 16).cast("string"))
    node = lambda n: F.when(n == 0, F.concat(prefix, F.lit("_ENTRY"))).otherwise(F.concat(prefix, F.lit("_N"), n.cast("string")))
    none = F.lit(None).cast("string")
    shape = "struct<next:string,result:string,category:string,label:string,action:string,note:string,score:int>"

    def branch(nxt=none, result=none, category=none, label=none, action=none):
        return F.struct(nxt.alias("next"), result.alias("result"), category.alias("category"), label.alias("label"), action.alias("action"),
                        none.alias("note"), F.lit(None).cast("int").alias("score")).cast(shape)
    leaf = (F.when(F.col("p_size") % 3 == 0, branch(result=pick(SCORE_IDS, F.col("p_size")), category=F.lit("HER2_Low"), label=F.col("p_name")))
            .when(F.col("p_size") % 3 == 1, branch(category=pick(CATEGORY_IDS, F.col("p_size")))).otherwise(branch(action=F.lit("recount"))))
    return read(spark, path, "part").select(
        node(j).alias("id"), F.when(j == 0, "entry").when(j % 4 == 1, F.lit(None)).otherwise("decision").alias("type"),
        F.concat(F.lit("is "), "p_name", F.lit("?")).alias("question"), F.concat(prefix, F.lit("_X")).alias("algorithm_id"),
        F.lit("ASCO_CAP_2023").alias("guideline_source"), F.when(j > 12, pick(SCORE_IDS, F.col("p_size"))).alias("result"),
        F.when(j > 12, pick(CATEGORY_IDS, F.col("p_size"))).alias("category"), F.when(j % 2 == 0, F.col("p_name")).alias("label"),
        none.alias("action"), none.alias("note"), F.when(j == 0, node(j + 1)).alias("next"), j.alias("node_order"),
        F.when(j.between(1, 7), branch(nxt=node(j * 2))).when(j > 7, leaf).alias("if_yes"),
        F.when(j.between(1, 7), branch(nxt=node(j * 2 + 1))).alias("if_no"))


def explicit_edges(spark, path):
    """Edges the tables state twice, and a way back from the last node."""
    prefix = F.concat(F.lit("A"), F.floor(F.col("p_partkey") / 16).cast("string"))
    at = lambda n: F.concat(prefix, F.lit(n))
    one = lambda a, b, c, lab: F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(c).alias("condition"), F.lit(lab).alias("label"))
    j = F.col("p_partkey") % 16
    return read(spark, path, "part").select(F.concat(prefix, F.lit("_X")).alias("algorithm_id"), F.explode(F.array_compact(F.array(
        F.when(j == 0, one(at("_ENTRY"), at("_N1"), "start", "begin")), F.when(j == 1, one(at("_N1"), at("_N2"), "YES", "")),
        F.when(j == 15, one(at("_N15"), at("_N1"), "again", "back"))))).alias("e")).select(
        "algorithm_id", "e.*")


def path_graph(spark, path):
    """Customers as scores, suppliers as ISH groups, nations as decisions, regions as categories."""
    t = lambda name: read(spark, path, name)
    node = (_nodes(t("customer"), "IHCScore", _id("C", "c_custkey"), F.col("c_name"))
            .unionByName(_nodes(t("supplier"), "ISHGroup", _id("S", "s_suppkey"), F.col("s_name")))
            .unionByName(_nodes(t("nation"), "DiagnosticDecision", _id("N", "n_nationkey"), F.col("n_name")))
            .unionByName(_nodes(t("region"), "ClinicalCategory", _id("R", "r_regionkey"), F.col("r_name")))
            .unionByName(_nodes(t("region"), "Assay", _id("A", "r_regionkey"), F.col("r_name"))))
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    lead = F.lit("leadsTo")
    edge = _edges(t("customer"), _id("C", "c_custkey"), F.lit("implies"), _id("N", "c_nationkey"))
    for part in (
        _edges(t("customer").filter(c % 3 == 0), _id("C", "c_custkey"), F.lit("requiresReflexTest"),
               F.concat(F.lit("A"), (c % 5).cast("string"))),
        _edges(t("customer"), _id("C", "c_custkey"), F.lit("requiresReflexTest"), F.concat(F.lit("N"), (F.col("c_nationkey") * 7 % 25).cast("string"))),
        _edges(t("supplier"), F.concat(F.lit("A"), (F.col("s_suppkey") % 5).cast("string")), F.lit("resultsIn"), _id("S", "s_suppkey")),
        _edges(t("supplier").filter(F.col("s_suppkey") % 4 != 0), _id("S", "s_suppkey"), lead, _id("N", "s_nationkey")),
        _edges(t("nation"), _id("N", "n_nationkey"), lead, F.concat(F.lit("N"), ((n + 1) % 25).cast("string"))),
        _edges(t("nation"), _id("N", "n_nationkey"), lead, F.concat(F.lit("N"), (n - n % 2 + (1 - n % 2)).cast("string"))).filter(F.col("src") != F.col("dst")),
        _edges(t("nation").filter(n % 3 == 0), _id("N", "n_nationkey"), lead, _id("R", "n_regionkey")),
    ):
        edge = edge.unionByName(part)
    return node, edge.dropDuplicates(["src", "predicate", "dst"])


def key_range(spark, path, name, key):
    """One more than the greatest key of a table."""
    return read(spark, path, name).agg(F.max(key)).first()[0] + 1


def live_edges(spark, path):
    from ..operators.graph import with_both_ends
    return with_both_ends(edges(spark, path), nodes(spark, path))


def requests(spark, path):
    """Documents as retrieval requests for three parts each."""
    k = F.col("doc_id")
    at = lambda a, b: F.concat(F.lit("P"), (k * a + b).cast("string"))
    return read(spark, path, "documents").select(k.alias("request_id"), F.array(at(1, 0), at(3, 1), at(5, 2)).alias("entity_ids"),
                                                 F.array(F.concat(F.lit("CUSTOMER#"), F.lpad((k % key_range(spark, path, "customer", "c_custkey")).cast("string"), 9, "0"))).alias("labels"))


def label_needles(spark, path):
    """Words of part names and endings of customer names, in odd case."""
    words = read(spark, path, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.upper("w").alias("needle"))
    ends = read(spark, path, "customer").select(F.expr("right(c_name, 4)").alias("needle"))
    tails = read(spark, path, "supplier").select(F.expr("right(s_name, 2)").alias("needle"))
    return words.unionByName(ends).unionByName(tails).unionByName(read(spark, path, "region").select(F.lit("").alias("needle"))).distinct()


def label_requests(spark, path):
    """Parts asking for two words each."""
    k = F.col("p_partkey")
    return read(spark, path, "part").select(k.alias("request_id"), F.explode(F.split("p_name", " ")).alias("needle"))


def answer_chunks(spark, path):
    """Assistant turns as evidence chunks."""
    return responses(spark, path).select(
        F.concat(F.lit("a"), F.col("response_id").cast("string")).alias("chunk_id"), F.col("response").alias("content"),
        F.concat(F.lit("src"), F.lpad((F.col("response_id") % 97).cast("string"), 2, "0")).alias("source_doc"),
        pick(["guideline", "evidence", "criteria", "clinical_trial"], F.col("response_id")).alias("content_type"))
