"""Graph tables to triples (subject, predicate, object, object_kind, datatype)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.props import kind, plain, prop
from ..sources.vocabulary import local_df
from .graph import export_edges, export_nodes

# --------------------------------------------------------------------------
# Public namespaces, classes, predicates, skipped properties
# --------------------------------------------------------------------------
NS = {
    "her2": "urn:oncolattice:her2#",  # default of our own; pass ``base`` to use another
    "ncit": "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#",
    "snomed": "http://snomed.info/id/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
CLASSES = [
    "ClinicalCategory", "IHCScore", "ISHGroup", "StainingPattern", "TherapeuticAgent",
    "ClinicalTrial", "Biomarker", "Guideline", "QualityMeasure", "FractalMetric",
    "PathologicalFeature", "Assay", "DiagnosticDecision", "Threshold", "Chunk",
]
CLASS_NAMES = {"Chunk": "DocumentChunk"}
PREDICATES = [
    "implies", "impliesIfISHAmplified", "impliesIfISHNonAmplified", "requiresReflexTest",
    "requiresIHCWorkup", "eligibleFor", "notEligibleFor", "definedIn", "hasQualityRequirement",
    "associatedWith", "proposedCorrelation", "proposedEquivalence", "inconsistentWith",
    "hasThreshold", "leadsTo", "conditionedOn", "overrides", "SUPERSEDED_BY",
    "supportedByEvidence", "hasStainingPattern", "contradictsIfConcurrent",
]
PREDICATE_NAMES = {"proposedEquivalence": "proposedCorrelation", "SUPERSEDED_BY": "supersededBy"}
NOT_EXPORTED = ["id", "ncit_uri", "snomed_uri", "embedding", "created_at", "type"]

OBJECT_END = "]}"  # of a JSON-LD node object

_TYPE, _SAME, _SUBCLASS, _LABEL = NS["rdf"] + "type", NS["owl"] + "sameAs", NS["rdfs"] + "subClassOf", NS["rdfs"] + "label"
_COLUMNS = ["subject", "predicate", "object", "object_kind", "datatype"]


def node_uri(node_id: Column, base: str) -> Column:
    """RDF1: id as a URI."""
    return F.concat(F.lit(base), F.translate(node_id, " /:", "___"))


def predicate_uri(predicate: Column, base: str) -> Column:
    """RDF6: predicate as a URI: subclass for refinements, two names mapped, others as they are."""
    named = F.when(predicate == "refinesCategory", F.lit(_SUBCLASS))
    for name, target in PREDICATE_NAMES.items():
        named = named.when(predicate == name, F.lit(base + target))
    return named.otherwise(F.concat(F.lit(base), predicate))


def _uri(subject, predicate, obj):
    return [subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), F.lit("uri").alias("object_kind"), F.lit(None).cast("string").alias("datatype")]


def declarations(spark: SparkSession, base: str = NS["her2"]) -> DataFrame:
    """RDF2 and RDF8: classes, properties and the disjointness of positive and negative."""
    def declared(name, uri, kind_uri):
        return [(uri, _TYPE, kind_uri, "uri", None), (uri, _LABEL, name, "literal", "string")]
    rows = [r for c in CLASSES for r in declared(c, base + CLASS_NAMES.get(c, c), NS["owl"] + "Class")]
    rows += [r for p in PREDICATES for r in declared(p, base + PREDICATE_NAMES.get(p, p), NS["owl"] + "ObjectProperty")]
    rows.append((base + "HER2_Positive", NS["owl"] + "disjointWith", base + "HER2_Negative", "uri", None))
    return local_df(spark, [(c, pa.string()) for c in _COLUMNS], rows)


def type_triples(nodes: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF3: class of every node, Entity when the type is unknown."""
    name = F.when(F.col("type") == "Chunk", "DocumentChunk").when(F.col("type").isin(CLASSES), F.col("type")).otherwise("Entity")
    return nodes.select(*_uri(node_uri(F.col("id"), base), F.lit(_TYPE), F.concat(F.lit(base), name)))


def same_as(nodes: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF4: links to the public vocabularies."""
    def link(name, prefix, space):
        value = prop(name)
        return F.when(value.startswith(prefix), F.concat(F.lit(space), F.substring(value, F.lit(len(prefix) + 1), F.length(value))))
    targets = F.array_compact(F.array(link("ncit_uri", "NCIt:", NS["ncit"]), link("snomed_uri", "snomed:", NS["snomed"])))
    return nodes.select("id", F.explode(targets).alias("_o")).select(*_uri(node_uri(F.col("id"), base), F.lit(_SAME), F.col("_o")))


def property_triples(nodes: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF5: label and other properties as typed literals."""
    rows = nodes.select("id", "label", F.explode_outer(F.map_filter("props", lambda k, v: ~k.isin(NOT_EXPORTED + ["label"]) & v.isNotNull())).alias("k", "v"))
    label = nodes.filter(F.col("label").isNotNull()).select("id", F.lit("label").alias("k"), F.col("label").alias("o"), F.lit("string").alias("t"))
    other = rows.filter(F.col("k").isNotNull()).select("id", "k", plain(F.col("v")).alias("o"), kind(F.col("v")).alias("t"))
    return label.unionByName(other).select(
        node_uri(F.col("id"), base).alias("subject"), F.concat(F.lit(base), "k").alias("predicate"), F.col("o").alias("object"),
        F.lit("literal").alias("object_kind"), F.col("t").alias("datatype"))


def edge_triples(edges: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF6: one triple per edge."""
    return edges.select(*_uri(node_uri(F.col("src"), base), predicate_uri(F.col("predicate"), base), node_uri(F.col("dst"), base)))


def axiom_triples(edges: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF7: five triples that annotate an edge with its confidence."""
    s, o, p = node_uri(F.col("src"), base), node_uri(F.col("dst"), base), predicate_uri(F.col("predicate"), base)
    none = F.lit(None).cast("string")

    def triple(predicate, obj, how="uri", datatype=none):
        return F.struct(F.lit(predicate).alias("predicate"), obj.alias("object"), F.lit(how).alias("object_kind"), datatype.alias("datatype"))
    five = F.array(triple(_TYPE, F.lit(NS["owl"] + "Axiom")), triple(NS["owl"] + "annotatedSource", s), triple(NS["owl"] + "annotatedProperty", p),
                   triple(NS["owl"] + "annotatedTarget", o), triple(base + "confidence", F.col("confidence").cast("string"), "literal", F.lit("decimal")))
    return edges.filter(F.col("confidence").isNotNull()).select(
        F.concat_ws("_", s, "predicate", o, F.lit("stmt")).alias("subject"), F.explode(five).alias("t")).select("subject", "t.*")


def _triple(subject, predicate, obj, how="uri", datatype=None):
    datatype = F.lit(None) if datatype is None else datatype
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), F.lit(how).alias("object_kind"),
                    datatype.cast("string").alias("datatype"))


def _with_uri(nodes: DataFrame, base: str) -> DataFrame:
    """Nodes with their URI (_me), so that it is worked out once and not once per triple."""
    return nodes.withColumn("_me", node_uri(F.col("id"), base))


def _node_triples(base: str) -> Column:
    """RDF3 to RDF5: all triples of a node with its URI."""
    def link(name, prefix, space):
        value = prop(name)
        return F.when(value.startswith(prefix), F.concat(F.lit(space), F.substring(value, F.lit(len(prefix) + 1), F.length(value))))
    me = F.col("_me")
    name = F.when(F.col("type") == "Chunk", "DocumentChunk").when(F.col("type").isin(CLASSES), F.col("type")).otherwise("Entity")
    fixed = F.array(_triple(me, F.lit(_TYPE), F.concat(F.lit(base), name)),
                    _triple(me, F.lit(_SAME), link("ncit_uri", "NCIt:", NS["ncit"])), _triple(me, F.lit(_SAME), link("snomed_uri", "snomed:", NS["snomed"])),
                    _triple(me, F.lit(base + "label"), F.col("label"), "literal", F.lit("string")))
    shown = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(NOT_EXPORTED + ["label"]) & v.isNotNull())
    other = F.transform(F.map_entries(shown), lambda e: _triple(me, F.concat(F.lit(base), e["key"]), plain(e["value"]), "literal", kind(e["value"])))
    return F.filter(F.concat(fixed, other), lambda t: t["object"].isNotNull())


def node_rows(nodes: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF3 to RDF5 in one explode: all triples of every node that is exported, with its id."""
    return _with_uri(export_nodes(nodes), base).select("id", F.explode(_node_triples(base)).alias("t")).select("id", "t.*")


def _note(base: str) -> Column:
    return F.concat_ws("_", node_uri(F.col("src"), base), "predicate", node_uri(F.col("dst"), base), F.lit("stmt"))


def _with_uris(edges: DataFrame, base: str) -> DataFrame:
    """Edges with the URIs of their ends, predicate and note (_s, _o, _p, _at_note), each worked out once and not once per triple."""
    named = edges.withColumns({"_s": node_uri(F.col("src"), base), "_o": node_uri(F.col("dst"), base), "_p": predicate_uri(F.col("predicate"), base)})
    return named.withColumn("_at_note", F.concat_ws("_", "_s", "predicate", "_o", F.lit("stmt")))


def _edge_triples(base: str) -> tuple[Column, Column, Column]:
    """RDF6 and RDF7: the triple of an edge with its URIs, the four that describe it, and its confidence, as arrays."""
    s, o, p, note = F.col("_s"), F.col("_o"), F.col("_p"), F.col("_at_note")
    four = F.array(_triple(note, F.lit(_TYPE), F.lit(NS["owl"] + "Axiom")), _triple(note, F.lit(NS["owl"] + "annotatedSource"), s),
                   _triple(note, F.lit(NS["owl"] + "annotatedProperty"), p), _triple(note, F.lit(NS["owl"] + "annotatedTarget"), o))
    return F.array(_triple(s, p, o)), four, F.array(_triple(note, F.lit(base + "confidence"), F.col("confidence").cast("string"), "literal", F.lit("decimal")))


def _shown_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are exported, reduced to what their triples depend on before they multiply."""
    return export_edges(edges.select("src", "predicate", "dst", "confidence").distinct(), nodes)


def edge_rows(edges: DataFrame, nodes: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF6 and RDF7 in one explode: all triples of every edge whose ends are exported, with the id of its source."""
    own, four, last = _edge_triples(base)
    all_ = F.when(F.col("confidence").isNull(), own).otherwise(F.concat(own, four, last))
    return _with_uris(_shown_edges(edges, nodes), base).select(F.col("src").alias("id"), F.explode(all_).alias("t")).select("id", "t.*")


def _kinds_apart(base: str) -> bool:
    """Whether under this base no triple of a node, of an edge, of its note and of the declarations can be the same.

    Ids hold none of the characters that their URIs replace, so a base with one of them tells notes, which hold it twice, from nodes.
    """
    fixed = [_TYPE, _SAME, _SUBCLASS, _LABEL, *(NS["owl"] + n for n in ("Axiom", "Class", "ObjectProperty", "disjointWith", "annotatedSource", "annotatedProperty", "annotatedTarget"))]
    return any(c in base for c in " /:") and not any(uri.startswith(base) for uri in fixed)


def triples(nodes: DataFrame, edges: DataFrame, base: str = NS["her2"]) -> DataFrame:
    """RDF9: the whole graph as a set of triples. Nodes and edges are each read once and give all their triples.

    Triples are not compared with each other, nodes and edges are, before they multiply: a node whose URI no other has gives
    its triples once; of edges that differ in confidence alone the first gives all triples, the others their confidence. What is
    left, several ids under one URI and edges of different ends or predicates with one note, is compared triple by triple.
    """
    if not _kinds_apart(base):
        rows = node_rows(nodes, base).unionByName(edge_rows(edges, nodes, base)).drop("id")
        return declarations(nodes.sparkSession, base).unionByName(rows).distinct()

    def spread_out(rows, array):
        return rows.select(F.explode(array).alias("t")).select("t.*")
    same = Window.partitionBy("_at")
    placed = _with_uri(export_nodes(nodes).select("type", "id", "label", "props", F.xxhash64(node_uri(F.col("id"), base)).alias("_at")).withColumn("_n", F.count("*").over(same)), base)
    out = [declarations(nodes.sparkSession, base).distinct(), spread_out(placed.filter("_n = 1"), F.array_distinct(_node_triples(base))),
           spread_out(placed.filter("_n > 1"), _node_triples(base)).distinct()]

    at = _note(base)
    for name, target in PREDICATE_NAMES.items():  # edges with equal triples, though of two names for a predicate, come together
        at = F.replace(at, F.lit(name), F.lit(target))
    key = F.struct("src", "predicate", "dst")
    by = same.orderBy(F.desc_nulls_last("confidence"))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = _shown_edges(edges, nodes).withColumn("_at", F.xxhash64(at)).withColumns(
        {"_place": F.row_number().over(by), "_one": F.min(key).over(whole).eqNullSafe(F.max(key).over(whole))})
    met = _with_uris(met, base)
    own, four, last = _edge_triples(base)
    none = F.filter(own, lambda t: F.lit(False))
    noted = F.when(F.col("confidence").isNull(), own).otherwise(F.concat(own, four, last))
    later = F.when(F.col("confidence").isNull(), none).otherwise(last)
    out += [spread_out(met.filter("_one"), F.when(F.col("_place") == 1, noted).otherwise(later)), spread_out(met.filter("not _one"), noted).distinct()]
    return reduce(DataFrame.unionByName, out)


def ntriples(rows: DataFrame) -> DataFrame:
    """Triples as N-Triples lines."""
    text = F.col("object")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("datatype") != "string", F.concat(F.lit("^^<" + NS["xsd"]), "datatype", F.lit(">"))).otherwise(""))
    obj = F.when(F.col("object_kind") == "uri", F.concat(F.lit("<"), "object", F.lit(">"))).otherwise(literal)
    return rows.select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), obj, F.lit(" .")).alias("value"))


def _json_string(text: Column) -> Column:
    """A string as a JSON string, null as null; most strings have nothing to escape."""
    packed = F.to_json(F.array(text))
    return F.when(text.isNull() | text.rlike(r'["\\\x00-\x1f]'), F.substring(packed, F.lit(2), F.length(packed) - 2)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _json_value() -> Column:
    """The object of a triple as a JSON-LD value."""
    typed = F.concat(F.lit('{"@type":'), _json_string(F.concat(F.lit(NS["xsd"]), "datatype")), F.lit(',"@value":'))
    return F.concat(F.when(F.col("object_kind") == "uri", F.lit('{"@id":')).when(F.col("datatype") == "string", F.lit('{"@value":')).otherwise(typed),
                    _json_string(F.col("object")), F.lit("}"))


def jsonld(rows: DataFrame) -> DataFrame:
    """Triples as JSON-LD node objects, one per triple: the form in which a row stands by itself."""
    return rows.select("subject", F.concat(F.lit('{"@id":'), _json_string(F.col("subject")), F.lit(","), _json_string(F.col("predicate")), F.lit(":["), _json_value(), F.lit("]}")).alias("value"))


def jsonld_objects(rows: DataFrame) -> DataFrame:
    """Triples as JSON-LD node objects, one per subject: the lines (value) in their order, a triple on each.

    The first line of an object opens it, the last one ends with OBJECT_END, which stands nowhere else before a line's end. The lines of a
    subject are next to each other in one task and never in one cell, so a hub needs no more memory than others. A triple without a
    predicate cannot be said in JSON-LD and is left out.
    """
    own = Window.partitionBy("_at", "subject").orderBy("predicate")  # by a number first, since subjects begin alike
    dealt = rows.filter(F.col("predicate").isNotNull()).select("subject", "predicate", "object", "object_kind", "datatype").repartition("subject")
    met = dealt.withColumn("_at", F.xxhash64("subject")).withColumns({"_before": F.lag("predicate").over(own), "_after": F.lead("predicate").over(own)})
    same = F.col("_before") == F.col("predicate")
    opened = F.concat(F.when(F.col("_before").isNull(), F.concat(F.lit('{"@id":'), _json_string(F.col("subject")), F.lit(","))).otherwise(F.lit("],")), _json_string(F.col("predicate")), F.lit(":["))
    return met.select(F.concat(F.when(same, F.lit(",")).otherwise(opened), _json_value(), F.when(F.col("_after").isNull(), F.lit(OBJECT_END)).otherwise(F.lit(""))).alias("value"))
