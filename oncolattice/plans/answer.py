"""Clinical queries answered for a whole table at once.

The agents a query needs are known up front, so every agent runs once over all queries
routed to it, and the results are folded per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import unnest
from ..operators import cases as c, paths as p, retrieval as t, routing as r
from ..operators.cases import ARROW


def diagnose(cases: DataFrame) -> DataFrame:
    """Class of every case with a short text."""
    text = F.concat_ws("\n", F.concat(F.lit("class: "), "classification"), F.concat(F.lit("score: "), "score"),
                       F.concat(F.lit("confidence: "), "confidence"), F.concat(F.lit("path: "), F.array_join("pathway_steps", ARROW)),
                       F.concat(F.lit("action: "), "action_required"))
    return c.classify(cases).withColumn("narrative", text)


def graph_class(cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PTH3 per case: where the paths of its score or group end; (case_id, graph_class)."""
    score = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(c.SCORES, c.SCORE_IDS) for x in pair]), F.coalesce("ihc_score", F.lit("")))
    asked = cases.select("case_id", score.alias("ihc_id"), F.col("ish_group").alias("ish_id"))
    return p.pathway(asked, p.score_paths(nodes, edges), p.ish_paths(nodes, edges)).select("case_id", F.col("final_classification").alias("graph_class"))


def case_eligibility(cases: DataFrame, diagnosed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """RET6 and RET7 per case: agents that its categories are or are not eligible for, as lines; (case_id, eligible)."""
    ids = cases.select("case_id", "category").join(diagnosed.select("case_id", "classification"), "case_id").select(
        "case_id", F.explode(t.categories(F.array("classification"), F.col("category"))).alias("category_id"))
    line = F.concat(F.lit("- "), "category", F.when(F.col("eligibility") == "eligibleFor", ": eligible for ").otherwise(": not eligible for "), "drug")
    return (ids.join(t.eligibility(nodes, edges).select("category_id", line.alias("line")), "category_id")
            .groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("eligible")))


def answer(queries: DataFrame, cases: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame,
           correlations: DataFrame | None = None, criteria: int | None = 5, max_passes: int | None = None,
           keyword_count: int | None = None, keyword_chars: int | None = None) -> DataFrame:
    """Agents run, confidence, review flag and text per query.

    ``queries(query_id, query, has_case, router_raw, ran, iteration, case_id)``; a query
    without a case has a null case_id. ``criteria`` says how many scoring criteria an explanation lists, None all;
    the other limits go to ``next_step`` and ``evidence``.
    """
    planned = unnest(r.next_step(r.route(queries), max_passes), ["query_id", "query", "case_id"], F.col("planned_agents"), "agent", "seq")

    def of(agent):
        return planned.filter(F.col("agent") == agent).select("query_id", "query", "case_id", "seq", "agent")

    none, zero = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    diagnosed = diagnose(cases)
    paths = graph_class(cases, nodes, edges)
    own = diagnosed.join(paths, "case_id", "left").select("case_id", "confidence", F.concat_ws(
        "\n", "narrative", F.concat(F.lit("graph path ends at: "), "graph_class")).alias("narrative"))
    diagnostic = of("diagnostic").join(own, "case_id", "left").select(
        "query_id", "seq", "agent", F.coalesce("confidence", F.lit("LOW")).alias("confidence"), zero.alias("critical_count"),
        F.coalesce("narrative", F.lit(c.ACTION_UNKNOWN)).alias("narrative"))

    cited = t.citations(t.evidence(of("evidence"), chunks, count=keyword_count, chars=keyword_chars, first=t.CITATIONS)).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kw_pos", "rank", F.concat(F.lit("- ["), "source", F.lit("] "), "text").alias("line")))), lambda s: s["line"]), "\n").alias("narrative"))
    able = case_eligibility(cases, diagnosed, nodes, edges)
    evidence = of("evidence").join(cited, "query_id", "left").join(able, "case_id", "left").select(
        "query_id", "seq", "agent", none.alias("confidence"), zero.alias("critical_count"),
        F.concat_ws("\n", F.coalesce("narrative", F.lit("no evidence found")), "eligible").alias("narrative"))

    listed = t.scoring_criteria(nodes)
    listed = (listed if criteria is None else listed.limit(criteria)).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.coalesce("label", "id")))), "\n").alias("criteria"))
    strength = F.format_number(F.coalesce("correlation", F.lit(0.0)), 2)
    linked = t.correlations(nodes, edges).agg(F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit("- "), "metric", F.lit(" ~ "), "category_label", F.lit(" ("), strength, F.lit(")")))), "\n").alias("linked"))
    facts = listed.withColumn("_k", F.lit(1)).join(linked.withColumn("_k", F.lit(1)), "_k")  # one row
    steps = diagnosed.select("case_id", F.concat(F.lit("path: "), t.pathway_text(F.col("pathway_steps"))).alias("path"))
    explanation = (of("explanation").join(steps, "case_id", "left").withColumn("_k", F.lit(1))
                   .join(F.broadcast(facts), "_k").select(
        "query_id", "seq", "agent", none.alias("confidence"), zero.alias("critical_count"), F.concat_ws("\n", "criteria", "path", F.when(F.col("linked") != "", F.col("linked"))).alias("narrative")))

    checked = c.validate(cases, correlations).select("case_id", F.col("critical_count").alias("n_critical"), F.concat(F.lit("status: "), "status").alias("text"))
    validation = of("validation").join(checked, "case_id", "left").select(
        "query_id", "seq", "agent", none.alias("confidence"), F.col("n_critical").alias("critical_count"), F.coalesce("text", F.lit("status: PASS")).alias("narrative"))

    results = diagnostic.unionByName(evidence).unionByName(explanation).unionByName(validation)
    agents = planned.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "agent"))), lambda s: s["agent"]), ",").alias("agents_invoked"))
    folded = r.synthesize(results).join(agents, "query_id")
    return queries.select("query_id").join(folded, "query_id", "left").select(
        "query_id", F.coalesce("agents_invoked", F.lit("")).alias("agents_invoked"), F.coalesce("confidence", F.lit(r.OTHER_CONFIDENCE)).alias("confidence"),
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("answer", F.lit(r.NO_RESULTS)).alias("answer"))
