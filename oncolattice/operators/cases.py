"""Case operators: classify, validate and explain one case per row.

All are projections over the case table, except the range check against
correlation edges and the specimen view, which join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import default_empty, empty_to_null, lits
from ..sources.vocabulary import ISH_ALGORITHM

# --------------------------------------------------------------------------
# Accepted spellings, steps, actions and messages
# --------------------------------------------------------------------------
SCORES = ["3+", "2+", "1+", "0+", "0"]
SCORE_IDS = ["Score3Plus", "Score2Plus", "Score1Plus", "Score0Plus", "Score0"]
SCORE_ALIASES = ["IHC3Plus", "IHC2Plus", "IHC1Plus", "IHC0Plus", "IHC0"]
SCORE_STEPS = [
    ["IHC_ENTRY", "IHC_NODE1 → YES", "Score3Plus"],
    ["IHC_ENTRY", "IHC_NODE1 → NO", "IHC_NODE2 → YES", "Score2Plus"],
    ["IHC_ENTRY", "IHC_NODE1 → NO", "IHC_NODE2 → NO", "IHC_NODE3 → YES", "Score1Plus"],
    ["IHC_ENTRY", "IHC_NODE1 → NO", "IHC_NODE2 → NO", "IHC_NODE3 → NO", "IHC_NODE4 → YES", "Score0Plus"],
    ["IHC_ENTRY", "IHC_NODE1 → NO", "IHC_NODE2 → NO", "IHC_NODE3 → NO", "IHC_NODE4 → NO", "IHC_NODE5 → terminal", "Score0"],
]
ACTION_REFLEX = "Reflex ISH testing required (ASCO/CAP 2023 mandate)"
ACTION_LOW = "Consider T-DXd eligibility assessment (DESTINY-Breast06)"
ACTION_ULTRALOW = "See Rakha 2026 / DESTINY-Breast06 expanded criteria"
ACTION_GROUP5 = "Consider T-DXd eligibility (IHC 2+/ISH-)"
ACTION_WORKUP = "Group %s workup: correlate with IHC and recount per ASCO/CAP Comment-A"
ACTION_UNKNOWN = "Insufficient data — provide IHC score (0, 0+, 1+, 2+, 3+)"
STEP_GROUP1 = "ISH_GROUP1_RESULT → HER2_Positive"
STEP_GROUP5 = "ISH_GROUP5_RESULT → HER2_Negative → HER2_Low"
STEP_WORKUP = "ISH_NODE_G%s_ENTRY → workup required"
ISSUE_NO_ISH = "IHC 2+ (Equivocal) requires reflex ISH testing — no ISH data provided"
ISSUE_BAD_SCORE = "IHC score '%s' is not a recognised value per ASCO/CAP 2023"
ISSUE_CONFLICT = (
    "IHC 3+ (Positive) but ISH Group 5 (Not Amplified) — "
    "direct conflict. Requires immediate case review and possible re-testing."
)
ISSUE_D0 = "Fractal D0=%s is outside expected range [%s, %s] for %s (metric: %s)"
ARROW = " → "

ISSUE_TYPE = "struct<rule_id:string,severity:string,description:string,type:string>"


def normal_score(col: Column) -> Column:
    """Any accepted spelling of a score as its short form, else null."""
    pairs = [F.lit(x) for names in (SCORES, SCORE_IDS, SCORE_ALIASES)
             for name, score in zip(names, SCORES) for x in (name, score)]
    return F.try_element_at(F.create_map(*pairs), default_empty(col))


def ish_group(ratio: Column, signals: Column) -> Column:
    """CAS3: ISH group from ratio and mean signals per cell."""
    high = ratio >= 2.0
    return (
        F.when(ratio.isNull() | signals.isNull(), F.lit(None))
        .when(high & (signals >= 4.0), "Group1")
        .when(high, "Group2")
        .when(signals >= 6.0, "Group3")
        .when(signals >= 4.0, "Group4")
        .otherwise("Group5")
    )


def classify(cases: DataFrame) -> DataFrame:
    """CAS1 and CAS2: class, steps, action, confidence and guideline of every case.

    An empty ISH group counts as missing.
    """
    score = F.col("_score")
    group = empty_to_null(F.col("ish_group"))
    number = F.trim(F.regexp_replace(group, "Group", ""))
    with_ish = (score == "2+") & group.isNotNull()

    def by_score(values, otherwise=None):
        picked = None
        for name, value in zip(SCORES, values):
            cell = value if isinstance(value, Column) else F.lit(value)
            picked = F.when(score == name, cell) if picked is None else picked.when(score == name, cell)
        return picked if otherwise is None else picked.otherwise(otherwise)

    base_steps = by_score([lits(s) for s in SCORE_STEPS], F.array().cast("array<string>"))
    ish_step = (F.when(number == "1", STEP_GROUP1).when(number == "5", STEP_GROUP5)
                .otherwise(F.format_string(STEP_WORKUP, number)))
    return (
        cases.withColumn("_score", normal_score(F.col("ihc_score")))
        .withColumn("classification",
                    F.when(with_ish, F.when(number == "1", "HER2_Positive").when(number == "5", "HER2_Low").otherwise("HER2_Equivocal"))
                    .otherwise(by_score(["HER2_Positive", "HER2_Equivocal", "HER2_Low", "HER2_Ultralow", "HER2_Null"], F.lit("UNKNOWN"))))
        .withColumn("score", F.coalesce(score, F.col("ihc_score")))
        .withColumn("pathway_steps", F.when(with_ish, F.concat(base_steps, F.array(ish_step))).otherwise(base_steps))
        .withColumn("action_required",
                    F.when(with_ish, F.when(number == "1", F.lit(None)).when(number == "5", ACTION_GROUP5)
                           .otherwise(F.format_string(ACTION_WORKUP, number)))
                    .otherwise(by_score([None, ACTION_REFLEX, ACTION_LOW, ACTION_ULTRALOW, None], F.lit(ACTION_UNKNOWN))))
        .withColumn("confidence",
                    F.when(with_ish, F.when(number.isin("1", "5"), "HIGH").otherwise("MEDIUM"))
                    .otherwise(by_score(["HIGH", "MEDIUM", "HIGH", "HIGH", "HIGH"], F.lit("LOW"))))
        .withColumn("applicable_guideline",
                    F.when(score == "0+", "Rakha_International_2026").when(score.isNotNull(), "ASCO_CAP_2023"))
        .drop("_score")
    )


def workup_table(decision_nodes: DataFrame) -> DataFrame:
    """Outcome per (ISH group, IHC class) read off the ISH decision table."""
    nodes = decision_nodes.filter(F.col("algorithm_id") == ISH_ALGORITHM)
    group = F.concat(F.lit("Group"), F.regexp_extract("id", "G(?:ROUP)?([1-5])", 1))
    yes = nodes.filter(F.col("if_yes").isNotNull()).select(
        group.alias("group"),
        F.when(F.col("id").endswith("IHC_CHECK"), "3+").otherwise("2+").alias("ihc_class"),
        F.col("if_yes.category").alias("outcome"), F.col("if_yes.action").alias("workup_action"))
    low = nodes.filter(F.col("id").endswith("IHC_LOW")).select(
        group.alias("group"), F.lit("low").alias("ihc_class"), F.col("category").alias("outcome"), F.col("action").alias("workup_action"))
    return yes.unionByName(low)


def group_workup(cases: DataFrame, decision_nodes: DataFrame) -> DataFrame:
    """CAS4: outcome of the group 2-4 workup given the concurrent IHC score.

    The table has nine rows, so Spark broadcasts it; other groups drop out.
    """
    score = normal_score(F.col("ihc_score"))
    keyed = cases.withColumn("group", ish_group(F.col("ish_ratio"), F.col("signals_per_cell"))).withColumn(
        "ihc_class", F.when(score.isin("3+", "2+"), score).when(score.isNotNull(), "low"))
    return keyed.join(workup_table(decision_nodes), ["group", "ihc_class"])


def _issue(rule: str, severity: str, text: Column, kind: str) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"),
                    text.alias("description"), F.lit(kind).alias("type"))


def rule_issues() -> Column:
    """CAS5: missing ISH on 2+ (CRITICAL) and unknown score (HIGH)."""
    ihc, ish = default_empty(F.col("ihc_score")), default_empty(F.col("ish_group"))
    accepted = ["3+", "Score3Plus", "2+", "Score2Plus", "1+", "Score1Plus", "0+", "Score0Plus", "0", "Score0", ""]
    return F.array_compact(F.array(
        F.when(ihc.isin("2+", "Score2Plus") & F.lower(ish).isin("", "none"),
               _issue("IHC2Plus_requires_ISH", "CRITICAL", F.lit(ISSUE_NO_ISH), "validation_rule")),
        F.when(~ihc.isin(accepted),
               _issue("INVALID_IHC_SCORE", "HIGH", F.format_string(ISSUE_BAD_SCORE, ihc), "validation_rule")),
    ))


def conflict_issues() -> Column:
    """CAS6: score 3+ against ISH group 5 (CRITICAL)."""
    clash = F.col("ihc_score").isin("3+", "Score3Plus") & F.col("ish_group").isin("5", "Group5", "ISH_GROUP5")
    return F.array_compact(F.array(
        F.when(clash, _issue("IHC_ISH_CONFLICT", "CRITICAL", F.lit(ISSUE_CONFLICT), "ish_conflict"))))


def fractal_issues(classified: DataFrame, correlations: DataFrame) -> DataFrame:
    """CAS7: one issue per correlation whose range the measured D0 falls outside of.

    ``correlations(category, metric_label, d0_low, d0_high)``. The join key has as
    many values as there are categories; the side is not hinted, so Spark
    broadcasts it when it measures small and splits skewed keys when it does not.
    """
    return (
        classified.filter(F.col("fractal_d0").isNotNull())
        .join(correlations, classified["classification"] == correlations["category_id"])
        .filter(~F.col("fractal_d0").between(F.col("d0_low"), F.col("d0_high")))
        .select("case_id", F.lit("FRACTAL_D0_RANGE").alias("rule_id"), F.lit("HIGH").alias("severity"),
                F.format_string(ISSUE_D0, F.col("fractal_d0").cast("string"), F.col("d0_low").cast("string"),
                                F.col("d0_high").cast("string"), F.col("category_id"), F.col("metric_label")).alias("description"),
                F.lit("fractal_consistency").alias("type"))
    )


def validate(cases: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """CAS8: severity counts, status and review flag of every case."""
    own = classify(cases).withColumn("issues", F.concat(rule_issues(), conflict_issues()))
    if correlations is not None:
        extra = fractal_issues(own, correlations).groupBy("case_id").agg(F.count("*").alias("_fractal"))
        own = own.join(extra, "case_id", "left")
    else:
        own = own.withColumn("_fractal", F.lit(0))

    def count(severity):
        return F.size(F.filter("issues", lambda i: i["severity"] == severity))

    counted = own.withColumn("critical_count", count("CRITICAL").cast("bigint")).withColumn(
        "high_count", (count("HIGH") + F.coalesce("_fractal", F.lit(0))).cast("bigint")).withColumn(
        "issue_count", (F.size("issues") + F.coalesce("_fractal", F.lit(0))).cast("bigint"))
    return counted.withColumn(
        "status", F.when(F.col("critical_count") > 0, "FAIL").when(F.col("issue_count") > 0, "WARN").otherwise("PASS")
    ).withColumn("needs_review", (F.col("critical_count") > 0) | (F.col("high_count") > 0)).drop("_fractal")


def specimen_consistency(specimens: DataFrame, edges: DataFrame) -> DataFrame:
    """CAS9: optional score, group and category linked to every specimen."""
    out = specimens.select(F.col("id").alias("specimen_id"))
    for predicate, name in (("hasIHCScore", "ihc_id"), ("hasISHGroup", "ish_id"), ("classifiedAs", "category")):
        side = edges.filter(F.col("predicate") == predicate).select(F.col("src").alias("specimen_id"), F.col("dst").alias(name))
        out = out.join(side, "specimen_id", "left")
    return out


def display(classified: DataFrame) -> DataFrame:
    """CAS10: response projection, action empty when none, steps joined."""
    return classified.select(
        "case_id", "classification", "ihc_score", "ish_group", "confidence",
        F.col("applicable_guideline").alias("guideline"),
        default_empty(F.col("action_required")).alias("action"),
        F.array_join("pathway_steps", ARROW).alias("pathway"))
