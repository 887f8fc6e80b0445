"""Integrity rules over the graph, all from one pass over its edges and nodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..sources.vocabulary import CATEGORY_IDS, ISH_GROUP_IDS

# --------------------------------------------------------------------------
# Rule ids, severities, sources; messages in our own words
# --------------------------------------------------------------------------
RULES = [
    ("IHC3Plus_implies_Positive", "CRITICAL", "ASCO/CAP 2023; CAP 2025; Rakha 2026", "score 3+ implies positive"),
    ("IHC2Plus_requires_ISH", "CRITICAL", "ASCO/CAP 2023", "score 2+ requires a reflex test"),
    ("Positive_disjoint_Negative", "CRITICAL", "Ontological axiom (Annex A)", "positive and negative do not refine each other"),
    ("ISH_Group1_positive", "CRITICAL", "ASCO/CAP 2023", "group 1 implies positive"),
    ("ISH_Group5_negative", "CRITICAL", "ASCO/CAP 2023 (Wolff 2023)", "group 5 implies low"),
    ("HER2Low_eligible_TDXd", "HIGH", "DESTINY-Breast04 (Modi 2022)", "low is eligible for T-DXd"),
    ("HER2Ultralow_eligible_TDXd", "HIGH", "DESTINY-Breast06 (Bardia 2024)", "ultralow is eligible for T-DXd"),
    ("HER2Null_not_eligible_TDXd", "HIGH", "Current evidence (2026)", "null is not eligible for T-DXd"),
    ("Fractal_marked_as_hypothesis", "HIGH", "Design constraint — fractal equivalences are exploratory", "metric equivalences are flagged as hypotheses"),
    ("All_5_categories_present", "HIGH", "Ontology completeness", "all categories are present"),
    ("All_5_ISH_groups_present", "HIGH", "ASCO/CAP 2023 — ISH 5-group system", "all ISH groups are present"),
    ("Equivocal_has_no_direct_therapy", "MEDIUM", "Clinical logic — equivocal status requires ISH before therapy decision", "equivocal has no direct therapy"),
    ("No_orphan_entities", "MEDIUM", "Graph quality", "no category, score or group without an edge"),
]
_LINKS = [  # rule, source type and id, predicate, target type and id
    ("IHC3Plus_implies_Positive", "IHCScore", "Score3Plus", "implies", "ClinicalCategory", "HER2_Positive"),
    ("ISH_Group1_positive", "ISHGroup", "Group1", "implies", "ClinicalCategory", "HER2_Positive"),
    ("ISH_Group5_negative", "ISHGroup", "Group5", "implies", "ClinicalCategory", "HER2_Low"),
    ("HER2Low_eligible_TDXd", "ClinicalCategory", "HER2_Low", "eligibleFor", "TherapeuticAgent", "TrastuzumabDeruxtecan"),
    ("HER2Ultralow_eligible_TDXd", "ClinicalCategory", "HER2_Ultralow", "eligibleFor", "TherapeuticAgent", "TrastuzumabDeruxtecan"),
    ("HER2Null_not_eligible_TDXd", "ClinicalCategory", "HER2_Null", "notEligibleFor", "TherapeuticAgent", "TrastuzumabDeruxtecan"),
]
_WATCHED = ["ClinicalCategory", "IHCScore", "ISHGroup"]


def _any(condition):
    return F.coalesce(F.bool_or(condition), F.lit(False))


def facts(nodes: DataFrame, edges: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """One row with the truth value of every rule, or of those in ``only``.

    Nodes and edges are each reduced by one conditional aggregate; only the orphan
    and the two typed checks need a join, after filters, and are left out where their rule is not asked for.
    """
    asked = {rule for rule, *_ in RULES} if only is None else set(only)
    def node(kind, node_id):
        return _any((F.col("type") == kind) & (F.col("id") == node_id))

    def present(kind, ids):
        return F.count_distinct(F.when((F.col("type") == kind) & F.col("id").isin(ids), F.col("id")))

    ends = {(k, i) for _, sk, s, _, tk, t in _LINKS for k, i in ((sk, s), (tk, t))}
    ends |= {("IHCScore", "Score2Plus"), ("ClinicalCategory", "HER2_Negative")}
    node_row = nodes.agg(*[node(k, i).alias(f"{k}.{i}") for k, i in sorted(ends)],
                         (present("ClinicalCategory", CATEGORY_IDS) == 6).alias("_categories"),
                         (present("ISHGroup", ISH_GROUP_IDS) == 5).alias("_groups"))

    def edge(src, predicate, dst):
        return _any((F.col("src") == src) & (F.col("predicate") == predicate) & (F.col("dst") == dst))
    edge_row = edges.agg(*[edge(s, p, t).alias("_" + rule) for rule, _, s, p, _, t in _LINKS],
                         _any((F.col("src") == "Score2Plus") & (F.col("predicate") == "requiresReflexTest")).alias("_reflex"),
                         (edge("HER2_Positive", "refinesCategory", "HER2_Negative") | edge("HER2_Negative", "refinesCategory", "HER2_Positive")).alias("_refines"))

    def of(kind, column):
        return nodes.filter(F.col("type") == kind).select(F.col("id").alias(column)).distinct()
    loose = (edges.filter((F.col("predicate") == "proposedEquivalence") & ~F.col("is_hypothesis").eqNullSafe(True))
             .join(of("FractalMetric", "src"), "src", "left_semi").join(of("ClinicalCategory", "dst"), "dst", "left_semi")
             .agg((F.count("*") == 0).alias("Fractal_marked_as_hypothesis")))
    therapy = (edges.filter((F.col("src") == "HER2_Equivocal") & (F.col("predicate") == "eligibleFor"))
               .join(of("TherapeuticAgent", "dst"), "dst", "left_semi").agg((F.count("*") == 0).alias("Equivocal_has_no_direct_therapy")))
    watched = nodes.filter(F.col("type").isin(_WATCHED)).select("id").distinct()
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(watched, "id", "left_semi").distinct()
    orphans = (watched.join(linked, "id", "left_anti")
               .agg((F.count("*") == 0).alias("No_orphan_entities")))

    row = node_row.withColumn("_k", F.lit(1))
    apart = {"Fractal_marked_as_hypothesis": loose, "Equivocal_has_no_direct_therapy": therapy, "No_orphan_entities": orphans}
    for other in [edge_row] + [part for rule, part in apart.items() if rule in asked]:  # one row each
        row = row.join(other.withColumn("_k", F.lit(1)), "_k")
    at = lambda k, i: F.col(f"`{k}.{i}`")
    links = [(F.col("_" + rule) & at(sk, s) & at(tk, t)).alias(rule) for rule, sk, s, _, tk, t in _LINKS]
    return row.select(
        *[rule for rule in apart if rule in asked], *links, (F.col("_reflex") & at("IHCScore", "Score2Plus")).alias("IHC2Plus_requires_ISH"),
        (at("ClinicalCategory", "HER2_Positive") & at("ClinicalCategory", "HER2_Negative") & ~F.col("_refines")).alias("Positive_disjoint_Negative"),
        F.col("_categories").alias("All_5_categories_present"), F.col("_groups").alias("All_5_ISH_groups_present"))


def run(nodes: DataFrame, edges: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """VAL1-VAL14: (rule_id, severity, source, valid, message), a row per rule, or per rule in ``only``."""
    asked = [r for r in RULES if only is None or r[0] in set(only)]
    rows = F.array(*[F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("severity"), F.lit(source).alias("source"),
                              F.coalesce(F.col(rule), F.lit(False)).alias("valid"), F.lit(text).alias("_text")) for rule, level, source, text in asked])
    return facts(nodes, edges, only).select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "message", F.when(F.col("valid"), F.concat(F.lit("holds: "), "_text")).otherwise(F.concat("severity", F.lit(": violated: "), "_text"))).drop("_text")


def report(results: DataFrame) -> DataFrame:
    """VAL15: totals; consistent when no CRITICAL or HIGH rule failed."""
    failed = ~F.col("valid")
    return results.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("passed"), F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("severity") == "CRITICAL")).alias("critical"),
        (F.count_if(failed & F.col("severity").isin("CRITICAL", "HIGH")) == 0).alias("is_consistent"))
