"""Context and evidence retrieval for tables of requests.

Where the result keeps k rows per request, the two sides that multiply (mentions and
edges of an entity) are each cut to their first k beforehand, after what has no node or chunk
at its other end is gone. With the order used here no row beyond can reach the result, and
the place of a pair among those of its entity follows from the places of its two sides, so
an entity hands k rows to a request, not k*k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.props import prop
from ..functions.substring_join import top_matches
from ..functions.text import default_empty, found_terms, lits, unnest
from .cases import ARROW, SCORE_IDS, SCORES
from .grounding import KNOWN_ENTITIES

# --------------------------------------------------------------------------
# Limits, terms, content types
# --------------------------------------------------------------------------
TOP_CONTEXT, TOP_LABELS, TOP_EVIDENCE, TOP_CORRELATIONS, CONTEXT_ROWS = 20, 10, 10, 5, 50
CITATIONS, CITATION_CHARS = 5, 150
EVIDENCE_TERMS = ["T-DXd", "trastuzumab deruxtecan", "pertuzumab", "trastuzumab", "DESTINY", "HER2-low", "HER2-ultralow",
                  "IHC", "ISH", "ASCO", "CAP", "ESMO", "NCCN", "Rakha"]
EVIDENCE_TYPES = ["guideline", "clinical_trial", "evidence"]
FALLBACK_SOURCES = ["ASCO_CAP_2023", "Rakha_International_2026"]


def _first(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def _out_edges(edges: DataFrame, nodes: DataFrame, ids: DataFrame, k: int, order: list, distinct: bool = False) -> DataFrame:
    """First k edges per source among ``ids`` that end at a node, with its label; ``distinct`` counts equal rows once."""
    own = edges.select(F.col("src").alias("entity_id"), F.col("predicate").alias("relation"), F.col("dst").alias("related_id"), "confidence").join(
        ids, "entity_id", "left_semi")
    ends = nodes.select(F.col("id").alias("related_id"), F.col("label").alias("related_entity"))
    rows = (own.distinct() if distinct else own).join(ends.distinct() if distinct else ends, "related_id")
    return _first(rows, "entity_id", [*order, "related_entity"], k)


def _mentions(mentions: DataFrame, chunks: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """First k mentions per entity among ``ids`` whose chunk is there."""
    own = mentions.join(ids, "entity_id", "left_semi").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return _first(own.select("chunk_id", "entity_id"), "entity_id", ["chunk_id"], k)


def retrieve(requests: DataFrame, mentions: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = TOP_CONTEXT) -> DataFrame:
    """RET1: chunks that mention the requested entities, with their out-edges; best confidence first, missing ones ahead.

    ``requests(request_id, entity_id)``, ``mentions(chunk_id, entity_id)``,
    ``chunks(chunk_id, content, source_doc)``.
    """
    asked = requests.select("request_id", "entity_id").distinct()
    ids = asked.select("entity_id").distinct()
    own, order = Window.partitionBy("entity_id"), [F.desc_nulls_first("confidence"), "relation", "related_id"]
    named = _mentions(mentions, chunks, ids, top_k).withColumn("_place", F.row_number().over(own.orderBy("chunk_id"))).withColumn("_of", F.count("*").over(own))
    out = _out_edges(edges, nodes, ids, top_k, order).withColumn("_before", F.rank().over(own.orderBy(*order)) - 1)
    labels = nodes.filter(F.col("type") != "Chunk").select(F.col("id").alias("entity_id"), F.col("label").alias("entity"))
    # a pair comes after every mention with an earlier edge, and after earlier mentions with its own
    per = named.join(labels, "entity_id").join(out, "entity_id", "left").filter(
        F.coalesce("_before", F.lit(0)) * F.col("_of") + F.col("_place") <= top_k).drop("_before", "_of", "_place")
    rows = asked.join(per, "entity_id")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(
        F.desc_nulls_first("confidence"), "entity_id", "relation", "related_id", "chunk_id"))).filter(F.col("rank") <= top_k)
    return best.join(chunks.select("chunk_id", F.col("content").alias("context"), "source_doc"), "chunk_id")


def find_by_label(needles: DataFrame, nodes: DataFrame, top: int = TOP_LABELS) -> DataFrame:
    """RET2: nodes whose label contains a needle, shortest label first."""
    texts = nodes.filter((F.col("type") != "Chunk") & F.col("label").isNotNull()).select(
        F.concat_ws("\x1f", "type", "id").alias("text_id"), F.col("label").alias("text"), "type", "id", "label", F.length("label").alias("_len"))
    return top_matches(texts, needles, ["_len", "id"], top).select("needle", "id", "label", F.col("type").alias("node_type"), "rank")


def retrieve_by_labels(requests: DataFrame, mentions, chunks, nodes, edges, top_k: int = TOP_CONTEXT) -> DataFrame:
    """RET3: labels of each request to distinct ids to RET1. ``requests(request_id, needle)``.

    What is found depends on the needles alone, so it is found once per distinct set of needles and then handed to the requests.
    """
    sets = requests.groupBy("request_id").agg(F.array_sort(F.collect_set("needle")).alias("needles"))
    found = find_by_label(requests.select("needle").distinct(), nodes).select("needle", F.col("id").alias("entity_id"))
    asked = sets.select("needles").distinct().select(F.col("needles").alias("request_id"), F.explode("needles").alias("needle"))
    best = retrieve(asked.join(found, "needle").select("request_id", "entity_id"), mentions, chunks, nodes, edges, top_k)
    return sets.join(best.withColumnRenamed("request_id", "needles"), "needles").drop("needles")


def keywords(query: Column, count: int | None = None, chars: int | None = None) -> Column:
    """RET5: known terms in the query, then the query itself or its first ``chars`` characters; the first ``count`` of these, or all."""
    every = F.concat(found_terms(query, EVIDENCE_TERMS), F.array(query if chars is None else F.substring(query, 1, chars)))
    return every if count is None else F.slice(every, 1, count)


def evidence(queries: DataFrame, chunks: DataFrame, types=tuple(EVIDENCE_TYPES), top: int = TOP_EVIDENCE,
             count: int | None = None, chars: int | None = None, first: int | None = None) -> DataFrame:
    """RET4: chunks of evidence types holding each keyword of a query, by source document.

    ``count`` and ``chars`` go to ``keywords``. With ``first`` a query keeps its first rows by keyword and rank, before texts join them.

    The best chunks are found once per distinct keyword and then handed to the
    queries that ask for it, so a term that a third of all queries use costs one lookup.
    """
    asked = unnest(queries, ["query_id"], keywords(F.col("query"), count, chars), "needle", "kw_pos")
    texts = chunks.filter(F.col("content_type").isin(list(types))).select(
        F.col("chunk_id").alias("text_id"), F.col("content").alias("text"), "source_doc", "content_type")
    hits = top_matches(texts, asked.select("needle"), ["source_doc"], top)
    rows = asked.join(hits, "needle").withColumnRenamed("text_id", "chunk_id")
    return ((rows if first is None else _first(rows, "query_id", ["kw_pos", "rank"], first))
            .join(chunks.select("chunk_id", F.col("content").alias("context")), "chunk_id"))


def categories(results: Column, own: Column) -> Column:
    """RET6: distinct category ids from earlier results and the case itself."""
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(results, F.array().cast("array<string>")), F.array(own))))


def eligibility(nodes: DataFrame, edges: DataFrame, category_ids: DataFrame | None = None) -> DataFrame:
    """RET7: eligible and not eligible agents of the given categories, or of all.

    ``category_ids(category_id)``; an empty table means all, as does None.
    """
    cats = nodes.filter(F.col("type") == "ClinicalCategory").select(F.col("id").alias("src"), F.col("label").alias("category"))
    if category_ids is not None and not category_ids.isEmpty():
        cats = cats.join(category_ids.select(F.col("category_id").alias("src")).distinct(), "src", "left_semi")
    drugs = nodes.filter(F.col("type") == "TherapeuticAgent").select(F.col("id").alias("dst"), F.col("label").alias("drug"))
    return (edges.filter(F.col("predicate").isin("eligibleFor", "notEligibleFor")).join(cats, "src").join(drugs, "dst")
            .select(F.col("src").alias("category_id"), "category", F.col("predicate").alias("eligibility"), F.col("dst").alias("drug_id"), "drug",
                    prop("clinical_context").alias("context"), prop("trial_evidence").alias("trial")))


def citations(evidence_rows: DataFrame) -> DataFrame:
    """RET8: the first five evidence rows of a query, texts cut to 150 characters."""
    first = _first(evidence_rows, "query_id", ["kw_pos", "rank"], CITATIONS)
    return first.select("query_id", "kw_pos", "rank", F.col("source_doc").alias("source"), F.col("content_type").alias("type"),
                        F.substring("context", 1, CITATION_CHARS).alias("text"))


def guideline_topics(needles: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = TOP_EVIDENCE) -> DataFrame:
    """RET9: guideline-covers-topic pairs whose labels hold a keyword, newest first."""
    guides = nodes.filter(F.col("type") == "Guideline").select(F.col("id").alias("src"), F.col("label").alias("guideline"), prop("year").cast("bigint").alias("year"))
    topics = nodes.select(F.col("id").alias("dst"), F.col("label").alias("topic"))
    pairs = edges.filter(F.col("predicate") == "covers").join(guides, "src").join(topics, "dst").select(
        F.concat_ws("\x1f", "src", "dst").alias("text_id"), F.concat_ws("\0", "guideline", "topic").alias("text"),
        F.col("src").alias("guideline_id"), "guideline", "year", "topic", (-F.coalesce("year", F.lit(2**62))).alias("_newest"))
    return top_matches(pairs, needles, ["_newest", "guideline_id"], top).select("needle", "guideline_id", "guideline", "year", "topic", "rank")


def static_evidence(requests: DataFrame, evidence_dim: DataFrame, guidelines: DataFrame) -> DataFrame:
    """RET10: eligible and not eligible agents and guidelines per requested category; unknown ones are not found.

    The evidence side holds a row per category; no hint is set, Spark measures it.
    """
    def agents(flag):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("eligible") == flag, F.col("agent")))), ", ")
    dim = evidence_dim.groupBy("category").agg(agents(True).alias("eligible_agents"), agents(False).alias("not_eligible_agents"))
    dim = guidelines.join(dim, "category").withColumnRenamed("category", "_norm")
    return requests.withColumn("_norm", F.replace("category", F.lit("-"), F.lit("_"))).join(dim, "_norm", "left").withColumn(
        "found", F.col("guidelines").isNotNull()).drop("_norm")


def scoring_criteria(nodes: DataFrame, kind: str = "IHCScore", by: str = "score") -> DataFrame:
    """RET11: nodes of a type by a numeric property, missing first, then descending."""
    return nodes.filter(F.col("type") == kind).select("id", "label", prop(by).cast("double").alias("score"), prop("staining_pattern").alias("staining_pattern"),
                                                      prop("percentage_threshold").alias("percentage_threshold")).orderBy(F.desc_nulls_first("score"), "id")


def correlations(nodes: DataFrame, edges: DataFrame, limit: int | None = TOP_CORRELATIONS, kind: str = "FractalMetric", strength: Column | None = None) -> DataFrame:
    """RET12 and QRY7: metric-category correlations, strongest first (missing ahead); ``limit`` None lists all."""
    metric = nodes.filter(F.col("type") == kind).select(F.col("id").alias("src"), F.col("label").alias("metric"))
    cats = nodes.filter(F.col("type") == "ClinicalCategory").select(F.col("id").alias("dst"), F.col("label").alias("category_label"))
    value = prop("correlation_strength").cast("double") if strength is None else strength
    rows = (edges.filter(F.col("predicate") == "proposedEquivalence").withColumn("correlation", value).join(metric, "src").join(cats, "dst")
            .select("metric", F.col("src").alias("metric_id"), "correlation", F.col("dst").alias("category"), "category_label"))
    ordered = rows.orderBy(F.desc_nulls_first("correlation"), "metric_id", "category")
    return ordered.limit(limit) if limit else ordered


def pathway_text(steps: Column) -> Column:
    """RET13: steps as one line."""
    return F.array_join(steps, ARROW)


def pathway_steps(text: Column) -> Column:
    """RET13, inverse."""
    return F.split(text, ARROW)


# ---- grounding context -----------------------------------------------------
def case_entity_ids(existing: Column, ihc: Column, ish: Column) -> Column:
    """RET16: ids asked for, plus those of the case's score and group, each once."""
    score = F.try_element_at(F.create_map(*[F.lit(x) for p in zip(SCORES, SCORE_IDS) for x in p]), default_empty(ihc))
    base = F.coalesce(existing, F.array().cast("array<string>"))
    extra = F.array_except(F.array_compact(F.array(score, F.when(ish != "", ish))), base)
    return F.concat(base, extra)


def _listed(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """(entity_id, array of the other columns as structs).

    Each member has its place among its entity's: how many come before it (``before``), how many share its key (``same``) and
    its number among these (``nth``).
    """
    order = Window.partitionBy("entity_id").orderBy(*keys)
    rows = rows.select("*", (F.rank().over(order) - 1).cast("long").alias("before"), (F.row_number().over(order) - F.rank().over(order)).cast("long").alias("nth"))
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy("entity_id", *keys)))
    return rows.groupBy("entity_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "entity_id"])).alias(name))


def _or_none(name: str, rows: DataFrame) -> Column:
    """The array, or one of one empty member."""
    given = {"before": 0, "same": 1, "nth": 0}
    empty = F.struct(*[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema[name].dataType.elementType.fields])
    return F.coalesce(name, F.array(empty)).alias(name)


def _rank(edge: Column, mention: Column) -> Column:
    """Place of an edge with a mention among the rows of the request, by the places of all parts."""
    ahead = edge["before"] * F.size("mentions") + edge["same"] * mention["before"]
    return F.col("before") + F.col("same") * ahead + (F.col("nth") * edge["same"] + edge["nth"]) * mention["same"] + mention["nth"] + 1


def context(requests: DataFrame, nodes: DataFrame, edges: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = CONTEXT_ROWS) -> DataFrame:
    """RET14, a row per request and entity: the entity, and its edges and mentions as arrays, for whoever pairs them.

    ``requests(request_id, entity_ids, labels)``. Rows of a request are ordered by entity, relation, related id and chunk. How many
    an entity has follows from the lengths of its two lists, so an entity that starts beyond ``limit`` is gone before it
    meets them, and pairs are ranked by ``_rank`` where they are made: neither pairs nor texts are sorted by request.
    """
    node = nodes.select(F.col("id").alias("entity_id"), "label", F.col("type").alias("node_type"))
    by_id = requests.select("request_id", F.explode("entity_ids").alias("entity_id")).join(node, "entity_id")
    wanted = requests.select("request_id", F.explode("labels").alias("_low")).withColumn("_low", F.lower("_low"))
    by_label = wanted.join(node.withColumn("_low", F.lower("label")), "_low").drop("_low")
    asked = by_id.unionByName(by_label).distinct()
    ids = asked.select("entity_id").distinct()
    texts = chunks.select("chunk_id", F.col("content").alias("context"), "source_doc").repartition("chunk_id").distinct()
    said = mentions.select("chunk_id", "entity_id").distinct().join(ids, "entity_id", "left_semi").join(texts, "chunk_id")
    out = _out_edges(edges, nodes, ids, limit, ["relation", "related_id"], distinct=True)
    sizes = asked.join(out.groupBy("entity_id").agg(F.count("*").alias("_out")), "entity_id", "left").join(
        said.groupBy("entity_id").agg(F.count("*").alias("_said")), "entity_id", "left").withColumn(
        "_n", F.least(F.coalesce("_out", F.lit(1)) * F.coalesce("_said", F.lit(1)), F.lit(limit)).cast("long"))
    order = Window.partitionBy("request_id").orderBy("entity_id", "node_type")
    upto, peers = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    placed = sizes.select(
        "request_id", "entity_id", "label", "node_type", (F.sum("_n").over(upto) - F.sum("_n").over(peers)).alias("before"),
        F.count("*").over(peers).alias("same"), (F.row_number().over(order) - F.rank().over(order)).cast("long").alias("nth"))
    listed, named = _listed(out, ["relation", "related_id"], "edges"), _listed(_first(said, "entity_id", ["chunk_id"], limit), ["chunk_id"], "mentions")
    return placed.filter(F.col("before") < limit).join(listed, "entity_id", "left").join(named, "entity_id", "left").select(
        *placed.columns, _or_none("edges", listed), _or_none("mentions", named))


def context_rows(requests: DataFrame, nodes: DataFrame, edges: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = CONTEXT_ROWS) -> DataFrame:
    """RET14: entities by id or lowercase label with optional relations and chunks, distinct, 50 rows a request."""
    pairs = context(requests, nodes, edges, mentions, chunks, limit).withColumn("e", F.explode("edges")).withColumn("m", F.explode(
        F.filter("mentions", lambda m: _rank(F.col("e"), m) <= limit)))
    return pairs.select("request_id", "entity_id", "label", "node_type", "e.relation", "e.related_id", "e.related_entity", "e.confidence",
                        "m.chunk_id", "m.context", "m.source_doc", _rank(F.col("e"), F.col("m")).alias("rank"))


def fold_context(found: DataFrame, limit: int = CONTEXT_ROWS) -> DataFrame:
    """RET15: distinct entities, relations, chunks, labels and sources in the rows of each request of ``context``.

    A request has at most ``limit`` rows, which bounds every list. An edge or a mention counts when a row within the limit holds it.
    """
    edges = F.filter("edges", lambda e: F.exists("mentions", lambda m: _rank(e, m) <= limit))
    mentions = F.filter("mentions", lambda m: F.exists("edges", lambda e: _rank(e, m) <= limit))
    used = found.select("request_id", "entity_id", "label", "node_type", edges.alias("edges"), mentions.alias("mentions")).filter(F.size("edges") > 0)
    relations = F.transform(F.filter("edges", lambda e: e["relation"].isNotNull() & (default_empty(e["related_entity"]) != "")), lambda e: F.struct(
        F.col("label").alias("from_label"), e["relation"].alias("relation"), e["related_entity"].alias("to_label"), e["confidence"].alias("confidence")))
    said = F.transform(F.filter("mentions", lambda m: default_empty(m["context"]) != ""), lambda m: F.struct(m["source_doc"].alias("source_doc"), m["context"].alias("context")))
    sources = F.array_distinct(F.array_compact(F.transform("mentions", lambda m: m["source_doc"])))
    parts = used.select("request_id", F.struct("entity_id", "label", "node_type").alias("entity"), relations.alias("relations"),
                        said.alias("chunks"), sources.alias("sources")).groupBy("request_id").agg(
        F.collect_list(F.struct("entity", "relations", "chunks", "sources")).alias("parts"))

    def set_of(items):
        return F.array_sort(F.array_distinct(F.array_compact(items)))

    def every(name):
        return set_of(F.flatten(F.col("parts")[name]))
    return parts.select("request_id", set_of(F.col("parts")["entity"]).alias("entities"), every("relations").alias("relations"), every("chunks").alias("chunks"),
                        set_of(F.transform(F.col("parts")["entity"], lambda e: F.lower(e["label"]))).alias("entity_labels"), every("sources").alias("source_docs"))


def fallback_context(requests: DataFrame) -> DataFrame:
    """RET17: context from the vocabulary alone."""
    return requests.select(
        "request_id", F.transform("entity_ids", lambda i: F.struct(i.alias("entity_id"), F.translate(i, "_", " ").alias("label"), F.lit("KGEntity").alias("node_type"))).alias("entities"),
        lits([k.lower() for k in KNOWN_ENTITIES]).alias("entity_labels"), lits(FALLBACK_SOURCES).alias("source_docs"))


def context_text(folded: DataFrame) -> DataFrame:
    """RET18: context as a text block: 15 entities, 15 relations, 3 excerpts of 300 characters, sources."""
    def section(title, items, count, line):
        return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(F.transform(F.slice(items, 1, count), line), "\n")))
    entity = section("**Entities:**\n", "entities", 15, lambda e: F.concat(
        F.lit("  - ["), e["node_type"], F.lit("] "), default_empty(e["label"]), F.lit(" (id: "), e["entity_id"], F.lit(")")))
    relation = section("\n**Relations:**\n", "relations", 15, lambda r: F.concat(
        F.lit("  - "), default_empty(r["from_label"]), F.lit(" --["), r["relation"], F.lit("]--> "), r["to_label"],
        F.when(F.coalesce(r["confidence"], F.lit(0.0)) != 0.0, F.concat(F.lit(" [confidence="), r["confidence"].cast("string"), F.lit("]"))).otherwise("")))
    chunk = section("\n**Source excerpts:**\n", "chunks", 3, lambda c: F.concat(
        F.lit("  ["), default_empty(c["source_doc"]), F.lit("] "), F.translate(F.substring(c["context"], 1, 300), "\n", " ")))
    sources = F.when(F.size("source_docs") > 0, F.concat(F.lit("\n**Sources:** "), F.array_join("source_docs", ", ")))
    return folded.withColumn("prompt_context", F.concat_ws(
        "\n", F.lit("### GROUNDED CONTEXT (verified KG facts)\n"), entity, relation, chunk, sources,
        F.lit("\n> IMPORTANT: Only reference the above entities and relations in your response.")))


# ---- documented user queries -------------------------------------------------
def category_edges(nodes: DataFrame, edges: DataFrame, limit: int | None = 30) -> DataFrame:
    """QRY1: out-edges of categories with labels."""
    cats = nodes.filter(F.col("type") == "ClinicalCategory").select(F.col("id").alias("src"), F.col("label").alias("category"))
    ends = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"))
    rows = edges.select("src", "predicate", "dst").join(cats, "src").join(ends, "dst").select("src", "category", "predicate", "dst", "target")
    ordered = rows.orderBy("src", "predicate", "dst", "target")
    return ordered.limit(limit) if limit else ordered


def eligible_categories(nodes: DataFrame, edges: DataFrame, agent_part: str) -> DataFrame:
    """QRY3: categories eligible for agents whose label holds a (case-sensitive) part."""
    rows = eligibility(nodes.filter((F.col("type") != "TherapeuticAgent") | F.col("label").contains(agent_part)), edges)
    return rows.filter(F.col("eligibility") == "eligibleFor").select("category_id", "category", "drug_id", "drug")


def eligibility_matrix(classified: DataFrame, evidence_dim: DataFrame, agents: list[str]) -> DataFrame:
    """QRY6: cases per category and agent, as 'eligible', 'not eligible', both or nothing, pivoted by agent."""
    cell = F.array_join(F.array_sort(F.collect_set(F.when(F.col("eligible"), "eligible").otherwise("not eligible"))), " / ")
    per = classified.groupBy(F.col("classification").alias("category")).agg(F.count("*").alias("cases"))
    wide = evidence_dim.groupBy("category").pivot("agent", agents).agg(cell)
    return per.join(wide, "category", "left")
