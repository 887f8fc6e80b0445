"""Property graph as node and edge tables.

nodes(type, id, label, props), key (type, id);
edges(src, predicate, dst, condition, algorithm_id, confidence, is_hypothesis, props),
key (src, predicate, dst, condition, algorithm_id).

Upserts fold property by property with a partial aggregate, so a key that is written
a billion times is reduced before the shuffle and no task collects its versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.props import json_text, plain, prop, props_map
from ..functions.text import default_empty
from .chunking import stored_text

NODE_KEY = ["type", "id"]
EDGE_KEY = ["src", "predicate", "dst", "condition", "algorithm_id"]


def _fold(rows: DataFrame, key: list[str], columns: dict[str, str], keep_non_empty: bool) -> DataFrame:
    """Last write per key and property; a null property value removes it.

    ``rows`` holds key, columns, props, ``_seq`` (-1 for what was there before) and ``_place``, which orders
    rows of one ``_seq``. Columns fold in one aggregate by key, reduced before the shuffle. Only properties are taken apart:
    they fold by key and name, again reduced first, and then make one map per key. Null keys are a marker meanwhile.
    """
    none = F.lit(None).cast("double")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("\0")) for c in key})

    def last(c, t):
        place = F.struct("_seq", "_place", (F.col(c) if t == "double" else none).alias("number"), F.col(c).cast("string").alias("value"))
        return F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    fixed = rows.groupBy(*key).agg(*[last(c, t) for c, t in columns.items()])
    given = F.map_entries(F.coalesce("props", F.create_map().cast("map<string,string>")))
    if keep_non_empty:
        given = F.filter(given, lambda e: (F.col("_seq") < 0) | ~F.coalesce(e["value"], F.lit("")).isin("", '""'))
    long = rows.select(*key, "_seq", "_place", F.explode(given).alias("e"))
    kept = long.groupBy(*key, F.col("e.key").alias("_name")).agg(
        F.max_by("e.value", F.struct("_seq", "_place", "e.value")).alias("_value")).filter("_value is not null")
    props = kept.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("_name").alias("key"), F.col("_value").alias("value"))))).alias("props"))
    folded = fixed.join(props, key, "left")
    return folded.select(*[F.nullif(F.col(c), F.lit("\0")).alias(c) for c in key], *columns,
                         F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def _arriving(rows: DataFrame) -> DataFrame:
    place = F.coalesce("place", F.lit("")) if "place" in rows.columns else F.lit("")
    return rows.withColumn("_place", place).withColumn("_seq", F.col("seq").cast("bigint")).drop("seq", "place")


def upsert_nodes(existing: DataFrame, incoming: DataFrame, policy: str = "overwrite") -> DataFrame:
    """GRF1: merge incoming nodes (with a ``seq`` of arrival, and maybe a ``place`` that orders rows of one seq) into the table.

    ``overwrite`` writes every given property, empty ones too; ``keep_non_empty``
    never replaces a value by an empty one.
    """
    rows = existing.select(*NODE_KEY, "label", "props", F.lit(-1).cast("bigint").alias("_seq"), F.lit("").alias("_place")).unionByName(
        _arriving(incoming).select(*NODE_KEY, "label", "props", "_seq", "_place"))
    return _fold(rows, NODE_KEY, {"label": "string"}, policy == "keep_non_empty").select("type", "id", "label", "props")


def node_props(props: Column) -> Column:
    """GRF2: properties to write: no key columns, no nulls."""
    return F.map_filter(props, lambda k, value: ~k.isin("type", "id") & value.isNotNull())


def _place() -> Column:
    """Order of extracted rows: chunk, then place in its answer."""
    return F.concat_ws("\0", default_empty(F.col("chunk_id")), F.format_string("%010d", F.col("pos"))).alias("place")


def entity_nodes(resolved: DataFrame, created_at: str) -> DataFrame:
    """GRF4: resolved entities as nodes, missing strings empty, with the place they came from."""
    def text(c):
        return json_text(default_empty(F.col(c)))
    return resolved.select(
        "type", "id", "label",
        props_map(definition=text("definition"), source_quote=text("source_quote"), ncit_uri=text("ncit_uri"), snomed_uri=text("snomed_uri"),
                  loinc_code=F.lit('""'), source_doc=text("chunk_id"), confidence=F.col("confidence"), evidence_level=F.lit('""'),
                  created_at=json_text(F.lit(created_at))).alias("props"), _place())


def chunk_nodes(chunks: DataFrame, created_at: str, stored_chars: int | None = None) -> DataFrame:
    """GRF8: chunks as nodes with their text, or its first ``stored_chars`` characters."""
    return chunks.select(
        F.lit("Chunk").alias("type"), F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("label"),
        props_map(source_doc=json_text(F.col("source_doc")), section=json_text(F.col("section")), text=json_text(stored_text(F.col("content"), stored_chars)),
                  content_type=json_text(F.col("content_type")), created_at=json_text(F.lit(created_at))).alias("props"))


def known_ids(nodes: DataFrame) -> DataFrame:
    """Ids in use under any type; ends of edges match by id alone."""
    return nodes.select("id").distinct()


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = known_ids(nodes)
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))


def force_hypothesis(edges: DataFrame) -> DataFrame:
    """GRF6: proposed equivalences are always hypotheses."""
    return edges.withColumn("is_hypothesis", F.when(F.col("predicate") == "proposedEquivalence", True).otherwise(F.col("is_hypothesis")))


def merge_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming edges (with ``seq``) merged into the table, whether or not their ends exist."""
    columns = {"confidence": "double", "is_hypothesis": "boolean"}
    rows = existing.withColumn("_seq", F.lit(-1).cast("bigint")).withColumn("_place", F.lit("")).unionByName(_arriving(force_hypothesis(incoming)))
    return _fold(rows, EDGE_KEY, columns, False).select(*EDGE_KEY, *columns, "props")


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF5: merge incoming edges (with ``seq``) whose ends both exist.

    Duplicates are folded first, so the two semi-joins see each edge once.
    """
    return with_both_ends(merge_edges(existing, incoming), nodes)


def relation_edges(relations: DataFrame, created_at: str) -> DataFrame:
    """Extracted relations (chunk_id, subject_id, predicate, object_id, confidence, evidence) as edges."""
    return relations.select(
        F.col("subject_id").alias("src"), "predicate", F.col("object_id").alias("dst"), F.lit(None).cast("string").alias("condition"),
        F.lit(None).cast("string").alias("algorithm_id"), "confidence", F.lit(False).alias("is_hypothesis"),
        props_map(evidence=json_text(default_empty(F.col("evidence"))), source_chunk=json_text(default_empty(F.col("chunk_id"))),
                  guideline_version=F.lit('""'), conditions=F.lit('""'), created_at=json_text(F.lit(created_at))).alias("props"),
        *([_place()] if "pos" in relations.columns else []))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF17: edges with a missing end, and which end."""
    ids = known_ids(nodes)
    gone_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").withColumn("missing", F.lit("src"))
    gone_dst = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").withColumn("missing", F.lit("dst"))
    return gone_src.unionByName(gone_dst)


def mentions(entities: DataFrame, chunks: DataFrame, nodes: DataFrame, skip=("Chunk", "ToySpecimen")) -> DataFrame:
    """GRF7: (chunk_id, entity_id) for entities whose chunk and node both exist."""
    pairs = entities.select(F.col("source_doc").alias("chunk_id"), F.col("id").alias("entity_id")).filter("chunk_id <> ''").distinct()
    real = nodes.filter(~F.col("type").isin(list(skip))).select(F.col("id").alias("entity_id")).distinct()
    return (pairs.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
            .join(real, "entity_id", "left_semi").select("chunk_id", "entity_id"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """GRF9: (type, id) pairs that are not unique."""
    return nodes.groupBy(*NODE_KEY).agg(F.count("*").alias("n")).filter("n > 1")


def node_counts(nodes: DataFrame) -> DataFrame:
    """GRF10 and QRY4: nodes per type, most first."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF10: node and edge totals in one row."""
    counted = nodes.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return counted.agg(F.sum("a").alias("total_nodes"), F.sum("b").alias("total_relations"))


def detach_delete(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """GRF11: drop nodes of some types and every edge at their ids.

    Edges go by id, so an id that survives under another type keeps its edges.
    """
    kept = nodes.filter(~F.col("type").isin(types))
    gone = nodes.filter(F.col("type").isin(types)).select("id").distinct().join(known_ids(kept), "id", "left_anti")
    left = (edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return kept, left.select(*edges.columns)


def correct_edges(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """GRF12: replace (src, predicate, old_dst) by (src, predicate, new_dst) with new properties.

    ``corrections(src, predicate, old_dst, new_dst, confidence, props)`` is a short
    curated list; it is joined without a hint and broadcast when it measures small.
    """
    drop = corrections.select("src", "predicate", F.col("old_dst").alias("dst"))
    add = corrections.select(
        "src", "predicate", F.col("new_dst").alias("dst"), F.lit(None).cast("string").alias("condition"),
        F.lit(None).cast("string").alias("algorithm_id"), "confidence",
        F.lit(None).cast("boolean").alias("is_hypothesis"), "props", F.lit(1).alias("_seq"))
    kept = edges.join(drop, ["src", "predicate", "dst"], "left_anti")
    touched = kept.join(add.select("src", "predicate", "dst").distinct(), ["src", "predicate", "dst"], "left_semi").withColumn("_seq", F.lit(-1))
    rest = kept.join(add.select("src", "predicate", "dst").distinct(), ["src", "predicate", "dst"], "left_anti").select(*edges.columns)
    folded = _fold(touched.unionByName(add).withColumn("_seq", F.col("_seq").cast("bigint")).withColumn("_place", F.lit("")), EDGE_KEY,
                   {"confidence": "double", "is_hypothesis": "boolean"}, False)
    return rest.unionByName(folded.select(*edges.columns))


def mention_fan_in(pairs: DataFrame, top: int = 10) -> DataFrame:
    """GRF13: most mentioned entities; counts are partial before the shuffle."""
    return pairs.groupBy("entity_id").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "entity_id").limit(top)


def extracted_count(nodes: DataFrame) -> DataFrame:
    """GRF14: entities that came from extraction rather than the seed."""
    source = prop("source_doc")
    return nodes.filter(~F.col("type").isin("Chunk", "ToySpecimen") & (source != "ontology:seed")).agg(F.count("*").alias("n"))


def load_seed(nodes: DataFrame, seed: DataFrame, policy: str = "overwrite") -> DataFrame:
    """GRF3: the curated seed written into the node table; writing it again changes nothing."""
    return upsert_nodes(nodes, seed.withColumn("seq", F.lit(1)), policy)


def content_type_counts(chunks: DataFrame) -> DataFrame:
    """GRF16: chunks per content type."""
    return chunks.groupBy("content_type").agg(F.count("*").alias("n"))


def implied_categories(nodes: DataFrame, edges: DataFrame, kind: str = "IHCScore") -> DataFrame:
    """QRY5: which categories the nodes of a type imply."""
    def ids(of, name):
        return nodes.filter(F.col("type") == of).select(F.col("id").alias(name)).distinct()
    return (edges.filter(F.col("predicate") == "implies").join(ids(kind, "src"), "src", "left_semi")
            .join(ids("ClinicalCategory", "dst"), "dst", "left_semi").select("src", "dst"))


def load_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a load wrote: rows per node type and per predicate."""
    return nodes.groupBy(F.lit("node").alias("part"), F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("part"), F.col("predicate").alias("name")).agg(F.count("*").alias("n")))


def neighbourhood(nodes: DataFrame, edges: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """GRF15: a page of nodes by id with their optional edges to non-chunk nodes."""
    picked = nodes.filter(F.col("type") == kind) if kind else nodes.filter(F.col("type") != "Chunk")
    page = picked.orderBy("id", "type").limit(limit).select(F.col("id").alias("src"), "type", "label")
    ends = nodes.filter(F.col("type") != "Chunk").select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    out = edges.select("src", "predicate", "dst").join(page.select("src").distinct(), "src", "left_semi").join(ends, "dst")
    return page.join(out, "src", "left").select("src", "type", "label", "predicate", "dst", "dst_label")


def export_nodes(nodes: DataFrame) -> DataFrame:
    """SRC10: nodes to export."""
    return nodes.filter((F.col("type") != "Chunk") & F.col("id").isNotNull() & (F.col("id") != ""))


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SRC11: edges between exportable nodes."""
    return with_both_ends(edges, export_nodes(nodes))


def quality_metrics(nodes: DataFrame, edges: DataFrame, hierarchy: DataFrame, predicates: list[str]) -> DataFrame:
    """MET1: share of hierarchy members present, of predicates used, of nodes with a source."""
    real = nodes.filter(F.col("type") != "Chunk")
    members = hierarchy.select(F.col("child").alias("id")).distinct()
    types = real.select(F.col("type").alias("id")).distinct().unionByName(real.select("id")).distinct()
    cover = members.join(types.withColumn("_hit", F.lit(1)), "id", "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("entity_coverage"))
    used = edges.filter(F.col("predicate").isin(predicates)).agg(
        (F.count_distinct("predicate") / F.lit(float(len(predicates)))).alias("predicate_coverage"))
    sourced = real.agg(F.avg((F.coalesce(plain(F.try_element_at("props", F.lit("source_doc"))), F.lit("")) != "").cast("int")).alias("provenance"))
    one = F.lit(1).alias("_k")
    return cover.select("*", one).join(used.select("*", one), "_k").join(sourced.select("*", one), "_k").drop("_k")
