"""Checks of generated answers against context, vocabulary and case data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import default_empty, lits

# --------------------------------------------------------------------------
# Vocabulary, patterns, messages, weights
# --------------------------------------------------------------------------
KNOWN_ENTITIES = [
    "HER2_Positive", "HER2_Equivocal", "HER2_Low", "HER2_Ultralow", "HER2_Null",
    "IHC_3plus", "IHC_2plus", "IHC_1plus", "IHC_0plus", "IHC_0",
    "ISH_Group1", "ISH_Group2", "ISH_Group3", "ISH_Group4", "ISH_Group5",
    "ASCO_CAP_2023", "CAP_2025", "ESMO_2023", "Rakha_International_2026",
    "DESTINY-Breast04", "DESTINY-Breast06",
    "Trastuzumab Deruxtecan", "T-DXd", "Trastuzumab",
    "Pertuzumab", "Lapatinib", "Tucatinib", "Margetuximab",
    "Breast Cancer", "HER2", "ERBB2",
]
VALID_SCORES = ["3+", "2+", "1+", "0+", "0"]
DRIFT_PATTERNS = [r"\bT-DM1\b", r"\bKadcyla\b", r"\bEnhertu\b", r"\bPertuzumab\b", r"\bNeratinib\b"]
NEGATIVE_PATTERN = r"\bHER2[-\s]Negative\b"
SCORE_PATTERN = r"\bIHC\s+([0-9]+\+?)"
NON_POSITIVE_PATTERN = r"HER2[-\s](Equivocal|Low|Ultralow|Null)"
THERAPY_PATTERN = r"T-DXd|trastuzumab deruxtecan"
EXPANDED_PATTERN = r"DESTINY-Breast06|Rakha 2026|not eligible|expanded crit"
CLAIM_PATTERN = r"(is eligible for|is not eligible for|is positive|is negative|is recommended|requires|must)"
CITATION_PATTERN = r"(ASCO|CAP|ESMO|NCCN|Rakha|DESTINY|PMID|guideline|trial|criteria)"
ABSOLUTE_PATTERNS = [r"\balways\b", r"\bnever\b", r"\bguaranteed\b", r"\b100%\b", r"\bwithout exception\b"]
MSG_NEGATIVE = ("Deprecated category 'HER2-Negative' used. "
                "Use HER2-Low, HER2-Ultralow, or HER2-Null per 2022+ guidelines.")
MSG_SCORE = "Unknown IHC score referenced: '%s'"
MSG_NON_POSITIVE = "IHC 3+ case: response claims non-positive HER2 category without ISH override."
MSG_THERAPY = ("IHC 0 case claims T-DXd eligibility without citing "
               "DESTINY-Breast06 / Rakha 2026 expanded criteria.")
MSG_PROVENANCE = "Multiple clinical claims made without guideline citations."
MAX_PENALTY = 0.5
# weights in hundredths of hallucinated terms, violations, unverified relations
PENALTY_WEIGHTS = (10, 15, 5)
SEVERITY_WEIGHTS = (2, 3, 1)

ANY_CASE = "(?iU)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_CASE + pattern), F.lit(group))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(ANY_CASE + pattern)


def drift(text: Column, context_labels: Column) -> Column:
    """GND1: watched terms neither in the context nor in the known vocabulary."""
    hits = F.array_sort(F.array_distinct(F.flatten(F.array(*[_all(text, p) for p in DRIFT_PATTERNS]))))
    vocabulary = F.concat(F.coalesce(context_labels, F.array().cast("array<string>")),
                          lits([k.lower() for k in KNOWN_ENTITIES]))
    return F.filter(hits, lambda term: ~F.array_contains(vocabulary, F.lower(term)))


def category_claims(text: Column) -> Column:
    """GND2: use of the deprecated negative category."""
    return F.array_compact(F.array(F.when(_has(text, NEGATIVE_PATTERN), F.lit(MSG_NEGATIVE))))


def score_claims(text: Column) -> Column:
    """GND3: every mention of a score that does not exist."""
    bad = F.filter(_all(text, SCORE_PATTERN, 1), lambda s: ~s.isin(VALID_SCORES))
    return F.transform(bad, lambda s: F.format_string(MSG_SCORE, s))


def case_claims(text: Column, ihc: Column, ish: Column) -> Column:
    """GND4: claims at odds with the case's own score."""
    return F.array_compact(F.array(
        F.when((ihc == "3+") & _has(text, NON_POSITIVE_PATTERN), F.lit(MSG_NON_POSITIVE)),
        F.when((ihc == "0") & (default_empty(ish) == "") & _has(text, THERAPY_PATTERN)
               & ~_has(text, EXPANDED_PATTERN), F.lit(MSG_THERAPY))))


def provenance(text: Column) -> Column:
    """GND5: more than three definite claims and no citation at all."""
    return F.array_compact(F.array(F.when(
        (F.regexp_count(text, F.lit(ANY_CASE + CLAIM_PATTERN)) > 3)
        & ~_has(text, CITATION_PATTERN), F.lit(MSG_PROVENANCE))))


def absolutes(text: Column) -> Column:
    """GND6: first hit of each absolute-language pattern."""
    return F.filter(F.array(*[F.regexp_extract(text, ANY_CASE + p, 0) for p in ABSOLUTE_PATTERNS]),
                    lambda hit: hit != "")


def severity(hallucinated: Column, unverified: Column, violations: Column) -> Column:
    """GND8: word for the weighted number of findings."""
    h, v, u = SEVERITY_WEIGHTS
    total = F.size(hallucinated) * h + F.size(unverified) * u + F.size(violations) * v
    return F.when(total == 0, "CLEAN").when(total <= 2, "LOW").when(total <= 5, "MEDIUM").otherwise("HIGH")


def quoted_list(items: Column) -> Column:
    """A list as text, each item in single quotes, or double where it holds one."""
    one = F.transform(items, lambda x: F.when(x.contains("'"), F.concat(F.lit('"'), x, F.lit('"')))
                      .otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))


def check(responses: DataFrame) -> DataFrame:
    """GND7-GND9: all findings, penalty, severity and summary of every response.

    ``responses(response, ihc_score, ish_group, context_labels, has_case)``; a plain
    projection, so it runs in the scan stage whatever the number of responses.
    """
    text = F.col("response")
    empty = F.array().cast("array<string>")
    found = (
        responses
        .withColumn("hallucinated", drift(text, F.col("context_labels")))
        .withColumn("unverified", empty)
        .withColumn("violations", F.concat(
            category_claims(text), score_claims(text),
            F.when(F.col("has_case"), case_claims(text, F.col("ihc_score"), F.col("ish_group"))).otherwise(empty)))
        .withColumn("missing_provenance", provenance(text))
        .withColumn("flagged", absolutes(text))
    )
    h, v, u = PENALTY_WEIGHTS
    hundredths = F.size("hallucinated") * h + F.size("violations") * v + F.size("unverified") * u
    scored = (
        found
        .withColumn("penalty", F.least(F.lit(MAX_PENALTY), hundredths / F.lit(100.0)))
        .withColumn("severity", severity(F.col("hallucinated"), F.col("unverified"), F.col("violations")))
        .withColumn("is_grounded", (F.size("hallucinated") == 0) & (F.size("violations") == 0))
    )

    def line(name, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(f"  {name}: "), quoted_list(F.col(items))))

    return scored.withColumn("summary", F.when(
        F.col("is_grounded"), F.lit("[GROUNDED] Response is fully grounded in the KG.")
    ).otherwise(F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("severity"), F.lit("] Grounding issues detected:")),
        line("Hallucinated entities", "hallucinated"), line("Unverified relations", "unverified"),
        line("Clinical rule violations", "violations"),
        F.when(F.col("penalty") > 0, F.format_string("  Confidence penalty: -%d%%", F.round(F.col("penalty") * 100).cast("int"))))))
