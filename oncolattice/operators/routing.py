"""Routing of queries to agents and synthesis of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import any_term, lits

# --------------------------------------------------------------------------
# Agents, trigger terms, confidence scale
# --------------------------------------------------------------------------
AGENTS = ["diagnostic", "evidence", "explanation", "validation"]
TRIGGERS = {
    "diagnostic": ["classify", "classification", "status", "ihc", "ish", "score",
                   "group", "what is", "her2", "biopsy", "result"],
    "evidence": ["eligible", "approved", "trial", "treatment", "therapy", "t-dxd",
                 "trastuzumab", "evidence", "guideline", "recommendation",
                 "destiny", "cleopatra", "her2climb"],
    "explanation": ["why", "explain", "explanation", "reason", "rationale", "how",
                    "equivocal", "mean", "pathway", "because"],
    "validation": ["consistent", "conflict", "valid", "validation", "check",
                   "inconsistent", "compatible"],
}
CONFIDENCE_SCALE = {"HIGH": 0.9, "MEDIUM": 0.6, "LOW": 0.3}
OTHER_CONFIDENCE = 0.5
NO_RESULTS = "(no agent results)"


def keyword_route(query: Column, has_case: Column) -> Column:
    """RTE1: ordered agents whose trigger terms occur; diagnostic when none does."""
    low = F.lower(query)
    hits = [any_term(low, TRIGGERS[a]) for a in AGENTS]
    hits[0] = hits[0] | has_case
    agents = F.array_compact(F.array(*[F.when(hit, F.lit(a)) for a, hit in zip(AGENTS, hits)]))
    return F.when(F.size(agents) > 0, agents).otherwise(lits(["diagnostic"]))


def parse_route(raw: Column) -> Column:
    """Agents named by the last bracketed array that parses and names any; else null."""
    text = F.trim(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""))
    arrays = F.reverse(F.regexp_extract_all(text, F.lit(r"(?s)\[.*?\]"), F.lit(0)))
    known = F.transform(arrays, lambda a: F.filter(
        F.coalesce(F.try_variant_get(F.try_parse_json(a), "$", "array<string>"), F.array().cast("array<string>")),
        lambda name: F.coalesce(name.isin(AGENTS), F.lit(False))))
    return F.try_element_at(F.filter(known, lambda names: F.size(names) > 0), F.lit(1))


def route(queries: DataFrame) -> DataFrame:
    """RTE2: parsed router output, falling back to keywords."""
    return queries.withColumn("target_agents", F.coalesce(
        parse_route(F.col("router_raw")), keyword_route(F.col("query"), F.col("has_case"))))


def next_step(routed: DataFrame, max_passes: int | None = None) -> DataFrame:
    """RTE3: next agent given those that ran, and the agents that will run in all.

    ``iteration`` counts supervisor passes so far; with ``max_passes`` the queue is cleared after so many.
    """
    planned = F.array_except("target_agents", "ran")
    if max_passes is not None:
        planned = F.slice(planned, F.lit(1), F.greatest(F.lit(0), F.lit(max_passes) - F.col("iteration")))
    return routed.withColumn("planned_agents", planned).withColumn(
        "next_agent", F.coalesce(F.try_element_at(planned, F.lit(1)), F.lit("synthesize")))


def confidence_score(col: Column) -> Column:
    """Number for a confidence word; missing stays null so that it is skipped."""
    scale = F.create_map(*[F.lit(x) for pair in CONFIDENCE_SCALE.items() for x in pair])
    return F.when(col != "", F.coalesce(F.try_element_at(scale, col), F.lit(OTHER_CONFIDENCE)))


def synthesize(results: DataFrame) -> DataFrame:
    """RTE4-RTE6: lowest confidence, review flag and joined narratives per query.

    ``results(query_id, seq, agent, confidence, critical_count, narrative)``. A
    query has at most one row per agent and pass, so the collected list is short.
    """
    block = F.concat(F.lit("**"), F.upper("agent"), F.lit(":**\n"), F.col("narrative"))
    return results.groupBy("query_id").agg(
        F.coalesce(F.min(confidence_score(F.col("confidence"))), F.lit(OTHER_CONFIDENCE)).alias("confidence"),
        F.bool_or((F.col("agent") == "validation") & (F.coalesce("critical_count", F.lit(0)) > 0)).alias("needs_review"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("block")))),
                                 lambda s: s["block"]), "\n\n").alias("answer"))
