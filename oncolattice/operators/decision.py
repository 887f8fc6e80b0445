"""Decision tables with interval conditions, compiled into one plan; the membrane staining matrix; rejection of assays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Span(NamedTuple):
    """low < x <= high; None is no bound."""
    low: float | None
    high: float | None


class Rule(NamedTuple):
    """Conditions by column (a value that must be equal, or a Span), and what follows."""
    when: dict[str, object]
    then: dict[str, object]


def _holds(name: str, asked) -> Column:
    at = F.col(name)
    if not isinstance(asked, Span):
        return at == F.lit(asked)
    bounds = [at > F.lit(asked.low)] if asked.low is not None else []
    bounds += [at <= F.lit(asked.high)] if asked.high is not None else []
    return reduce(Column.__and__, bounds, at.isNotNull())


def matches(rules: Sequence[Rule]) -> Column:
    """Numbers, from 0, of all rules that hold for a row. A null never meets a condition."""
    met = [F.when(reduce(Column.__and__, [_holds(c, v) for c, v in r.when.items()], F.lit(True)), F.lit(k)) for k, r in enumerate(rules)]
    return F.array_compact(F.array(*met))


def decide(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` with what follows from the first rule that holds, and the number of rules that do as n_rules (0: nothing follows)."""
    names = list(dict.fromkeys(c for r in rules for c in r.then))
    marked = rows.withColumn("_met", matches(rules))
    then = {c: F.when(F.size("_met") > 0, F.element_at(F.array(*[F.lit(r.then.get(c)) for r in rules]), F.array_min("_met") + 1)) for c in names}
    return marked.withColumns(then | {"n_rules": F.size("_met").cast("long")}).drop("_met")


def audit(spark: SparkSession, rules: Sequence[Rule], domain: dict[str, Sequence] | None = None) -> DataFrame:
    """Where the table says nothing or too much: one row per cell that no rule or several rules cover, with their numbers as met.

    The bounds of all spans cut each column into pieces, of which one point each is tried; other columns take the values that
    rules name, and those of ``domain``. The cells are tried by the same plan that decides rows.
    """
    columns = list(dict.fromkeys(c for r in rules for c in r.when))
    cells = spark.range(1)
    for c in columns:
        asked = [r.when[c] for r in rules if c in r.when]
        bounds = sorted({float(b) for s in asked if isinstance(s, Span) for b in s if b is not None})
        if bounds:
            points = [*bounds, bounds[-1] + 1.0]  # each bound stands for the piece that ends there
        else:
            points = sorted({*(v for v in asked if not isinstance(v, Span)), *(domain or {}).get(c, ())})
        cells = cells.withColumn(c, F.explode(F.array(*[F.lit(p) for p in points])))
    return cells.withColumn("met", matches(rules)).filter(F.size("met") != 1).select(*columns, "met")


# Membrane staining by intensity, completeness and share of cells (more than 10 percent or not).
STAINING = [
    ("Strong", "Complete", ">10", "3+", "HER2_Positive"),
    ("Strong", "Complete", "<=10", "2+", "HER2_Equivocal"),
    ("Strong", "Incomplete", ">10", "2+", "HER2_Equivocal"),
    ("Strong", "Incomplete", "<=10", "1+", "HER2_Low"),
    ("Moderate", "Complete", ">10", "2+", "HER2_Equivocal"),
    ("Moderate", "Complete", "<=10", "2+", "HER2_Equivocal"),
    ("Moderate", "Incomplete", ">10", "2+", "HER2_Equivocal"),
    ("Moderate", "Incomplete", "<=10", "1+", "HER2_Low"),
    ("Weak", "Complete", ">10", "2+", "HER2_Equivocal"),
    ("Weak", "Complete", "<=10", "1+", "HER2_Low"),
    ("Weak", "Incomplete", ">10", "1+", "HER2_Low"),
    ("Weak", "Incomplete", "<=10", "0+", "HER2_Ultralow"),
    ("Faint", "Complete", ">10", "1+", "HER2_Low"),
    ("Faint", "Complete", "<=10", "0+", "HER2_Ultralow"),
    ("Faint", "Incomplete", ">10", "1+", "HER2_Low"),
    ("Faint", "Incomplete", "<=10", "0+", "HER2_Ultralow"),
    ("None", None, None, "0", "HER2_Null"),
]
SCORES = ["0", "0+", "1+", "2+", "3+"]  # weakest first
SPANS = {">10": Span(10.0, None), "<=10": Span(None, 10.0)}
STAINING_RULES = [Rule({c: v for c, v in (("intensity", a), ("circumference", b), ("percent", SPANS.get(p))) if v is not None}, {"score": s, "category": c})
                  for a, b, p, s, c in STAINING]


def score_regions(regions: DataFrame, rules: Sequence[Rule] = STAINING_RULES) -> DataFrame:
    """Score of a tumour from its regions, ``regions(case_id, intensity, circumference, percent, cells)``: the highest score of any.

    Gives (case_id, score, category, n_regions, n_unscored, shares). shares tells the percentage of scored cells at every score, highest first, as
    "3+ 40%, 1+ 60%" (rounded down). Regions that no rule covers are unscored; a case of only such regions has a null
    score, category and shares. Null or negative cells count as none; without cells there are no shares.
    Regions are summed per case and score first, so a case with any number of regions is at most a handful of rows after that.
    """
    level = F.array_position(F.array(*[F.lit(s) for s in SCORES]), F.col("score"))
    cells = F.greatest(F.coalesce(F.col("cells").cast("long"), F.lit(0)), F.lit(0))
    per = decide(regions.withColumn("_cells", cells), rules).groupBy("case_id", level.alias("level"), "score").agg(
        F.count("*").alias("n"), F.sum("_cells").alias("cells"), F.min("category").alias("category"))
    scored = F.col("level").isNotNull()
    case = per.groupBy("case_id").agg(
        F.max_by("score", F.when(scored, F.col("level"))).alias("score"), F.max_by("category", F.when(scored, F.col("level"))).alias("category"),
        F.sum("n").alias("n_regions"), F.sum(F.when(scored, 0).otherwise(F.col("n"))).alias("n_unscored"),
        F.sum(F.when(scored, F.col("cells"))).alias("all"), F.collect_list(F.when(scored, F.struct("level", "score", "cells"))).alias("parts"))
    parts = F.transform(F.reverse(F.array_sort("parts")), lambda p: F.concat(p["score"], F.lit(" "), ((p["cells"] * 100 - p["cells"] * 100 % F.col("all")) / F.col("all")).cast("long").cast("string"), F.lit("%")))
    return case.select("case_id", "score", "category", "n_regions", "n_unscored", F.when(F.col("all") > 0, F.array_join(parts, ", ")).alias("shares"))


# Limits beyond which a probe assay is rejected and reported as indeterminate.
MIN_AREAS, MAX_WEAK_PERCENT, MAX_CYTOPLASM_PERCENT = 2, 25, 10
REJECTIONS = ["controls", "invasive_areas", "weak_signals", "cytoplasmic_signals", "nuclear_resolution", "autofluorescence"]


def reject_assays(assays: DataFrame) -> DataFrame:
    """``assays`` with reasons (those of REJECTIONS that apply, in order) and outcome: Indeterminate where there is one, else Accepted.

    Reads controls_ok, poor_resolution, autofluorescence (booleans), invasive_areas, weak_percent, cytoplasm_percent. What was not recorded
    (null) rejects nothing; the reasons it might have given are listed in unknown.
    """
    c = F.col
    tests = [~c("controls_ok"), c("invasive_areas") < MIN_AREAS, c("weak_percent") > MAX_WEAK_PERCENT, c("cytoplasm_percent") > MAX_CYTOPLASM_PERCENT,
             c("poor_resolution"), c("autofluorescence")]
    listed = {name: F.array_compact(F.array(*[F.when(cond(t), F.lit(r)) for r, t in zip(REJECTIONS, tests)]))
              for name, cond in (("reasons", lambda t: t), ("unknown", lambda t: t.isNull()))}
    return assays.withColumns(listed).withColumn("outcome", F.when(F.size("reasons") > 0, "Indeterminate").otherwise("Accepted"))
