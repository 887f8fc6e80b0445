"""Registered queries: cases, routing, grounding, evidence lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import unnest
from ..operators import cases as c, grounding as g, routing as r
from ..sources import vocabulary as v
from . import duck_inputs as _d, inputs as i
from .registry import query, sql_list, table, values

# ---- classification --------------------------------------------------------
_steps = {s: "|".join(p) for s, p in zip(c.SCORES, c.SCORE_STEPS)}
_alias = [(a, s) for names in (c.SCORES, c.SCORE_IDS, c.SCORE_ALIASES) for a, s in zip(names, c.SCORES)]
table("v_alias", values(_alias, ["spelling", "score"]))
table("v_outcome", values([
    ("3+", "HER2_Positive", None, "HIGH", "ASCO_CAP_2023", _steps["3+"]),
    ("2+", "HER2_Equivocal", c.ACTION_REFLEX, "MEDIUM", "ASCO_CAP_2023", _steps["2+"]),
    ("1+", "HER2_Low", c.ACTION_LOW, "HIGH", "ASCO_CAP_2023", _steps["1+"]),
    ("0+", "HER2_Ultralow", c.ACTION_ULTRALOW, "HIGH", "Rakha_International_2026", _steps["0+"]),
    ("0", "HER2_Null", None, "HIGH", "ASCO_CAP_2023", _steps["0"]),
], ["score", "classification", "action", "confidence", "guideline", "steps"]))
table("classified", f"""
SELECT case_id, ihc_score, ish_group, fractal_d0, category, ish_ratio, signals_per_cell,
 CASE WHEN ish THEN CASE g WHEN '1' THEN 'HER2_Positive' WHEN '5' THEN 'HER2_Low' ELSE 'HER2_Equivocal' END
  ELSE coalesce(classification, 'UNKNOWN') END AS classification,
 coalesce(score, ihc_score) AS score,
 CASE WHEN ish THEN CASE g WHEN '1' THEN NULL WHEN '5' THEN '{c.ACTION_GROUP5}' ELSE replace('{c.ACTION_WORKUP}', '%s', g) END
  WHEN score IS NULL THEN '{c.ACTION_UNKNOWN}' ELSE action END AS action_required,
 CASE WHEN ish THEN CASE WHEN g IN ('1', '5') THEN 'HIGH' ELSE 'MEDIUM' END ELSE coalesce(confidence, 'LOW') END AS confidence,
 guideline,
 CASE WHEN ish THEN steps || '|' || CASE g WHEN '1' THEN '{c.STEP_GROUP1}' WHEN '5' THEN '{c.STEP_GROUP5}' ELSE replace('{c.STEP_WORKUP}', '%s', g) END
  ELSE coalesce(steps, '') END AS steps
FROM (SELECT ca.*, o.*, (a.score = '2+' AND coalesce(ca.ish_group, '') <> '') AS ish, replace(ca.ish_group, 'Group', '') AS g
 FROM cases ca LEFT JOIN v_alias a ON ca.ihc_score = a.spelling LEFT JOIN v_outcome o ON a.score = o.score)""",
      "cases", "v_alias", "v_outcome")


def _classified(spark, path):
    return c.classify(i.cases(spark, path))


@query("CAS1", """SELECT case_id, score, classification, action_required, confidence, guideline, steps FROM classified""", ("classified",))
def cas1(spark, path):
    return _classified(spark, path).select(
        "case_id", "score", "classification", "action_required", "confidence",
        F.col("applicable_guideline").alias("guideline"), F.array_join("pathway_steps", "|").alias("steps"))


@query("CAS2", """SELECT ish_group, classification, action_required, steps, count(*) AS n FROM classified
 WHERE score = '2+' AND ish_group <> '' GROUP BY ALL""", ("classified",))
def cas2(spark, path):
    return (_classified(spark, path).filter((F.col("score") == "2+") & (F.col("ish_group") != ""))
            .groupBy("ish_group", "classification", "action_required", F.array_join("pathway_steps", "|").alias("steps"))
            .agg(F.count("*").alias("n")))


@query("CAS3", f"SELECT case_id, {_d.ISH_SQL.format(r='ish_ratio', s='signals_per_cell')} AS ish_group FROM cases", ("cases",))
def cas3(spark, path):
    return i.cases(spark, path).select("case_id", c.ish_group(F.col("ish_ratio"), F.col("signals_per_cell")).alias("ish_group"))


@query("CAS4", f"""SELECT case_id, g AS "group", ic AS ihc_class,
 CASE ic WHEN '3+' THEN 'HER2_Positive' WHEN '2+' THEN NULL ELSE 'HER2_Negative' END AS outcome,
 CASE ic WHEN '2+' THEN '{v.RECOUNT_ACTION}' END AS workup_action
FROM (SELECT case_id, {_d.ISH_SQL.format(r='ish_ratio', s='signals_per_cell')} AS g,
  CASE WHEN score IN ('3+', '2+') THEN score WHEN score <> 'bad_value' THEN 'low' END AS ic FROM classified)
WHERE g IN ('Group2', 'Group3', 'Group4') AND ic IS NOT NULL""", ("classified",))
def cas4(spark, path):
    return c.group_workup(i.cases(spark, path), v.decision_nodes_df(spark)).select(
        "case_id", "group", "ihc_class", "outcome", "workup_action")


_rule_sql = f"""
SELECT case_id, 'IHC2Plus_requires_ISH' AS rule_id, 'CRITICAL' AS severity, '{c.ISSUE_NO_ISH}' AS description FROM cases
 WHERE ihc_score IN ('2+', 'Score2Plus') AND coalesce(ish_group, '') = ''
UNION ALL SELECT case_id, 'INVALID_IHC_SCORE', 'HIGH', 'IHC score ''' || ihc_score || ''' is not a recognised value per ASCO/CAP 2023' FROM cases
 WHERE ihc_score IN ('IHC3Plus', 'bad_value')"""
table("rule_issues", _rule_sql, "cases")
table("conflicts", f"""SELECT case_id, 'IHC_ISH_CONFLICT' AS rule_id, 'CRITICAL' AS severity, '{c.ISSUE_CONFLICT}' AS description
 FROM cases WHERE ihc_score IN ('3+', 'Score3Plus') AND ish_group IN ('5', 'Group5', 'ISH_GROUP5')""", "cases")
table("d0_issues", """SELECT case_id, 'FRACTAL_D0_RANGE' AS rule_id, 'HIGH' AS severity, metric_label, d0_low, d0_high, fractal_d0
 FROM classified JOIN correlations ON classification = category_id
 WHERE fractal_d0 < d0_low OR fractal_d0 > d0_high""", "classified", "correlations")


def _issue_rows(df, issues):
    return unnest(df, ["case_id"], issues, "i").select("case_id", "i.rule_id", "i.severity", "i.description")


@query("CAS5", "SELECT * FROM rule_issues", ("rule_issues",))
def cas5(spark, path):
    return _issue_rows(i.cases(spark, path), c.rule_issues())


@query("CAS6", "SELECT * FROM conflicts", ("conflicts",))
def cas6(spark, path):
    return _issue_rows(i.cases(spark, path), c.conflict_issues())


@query("CAS7", """SELECT case_id, rule_id, severity, 'Fractal D0=' || fractal_d0 || ' is outside expected range [' || d0_low || ', '
 || d0_high || '] for ' || classification || ' (metric: ' || metric_label || ')' AS description FROM d0_issues JOIN classified USING (case_id, fractal_d0)""",
       ("d0_issues", "classified"))
def cas7(spark, path):
    return c.fractal_issues(_classified(spark, path), i.correlations(spark, path)).drop("type")


@query("CAS8", """SELECT case_id, cc AS critical_count, hc AS high_count, cc + hc AS issue_count,
 CASE WHEN cc > 0 THEN 'FAIL' WHEN cc + hc > 0 THEN 'WARN' ELSE 'PASS' END AS status, cc + hc > 0 AS needs_review
FROM (SELECT c.case_id, count(CASE WHEN s.severity = 'CRITICAL' THEN 1 END) AS cc, count(CASE WHEN s.severity = 'HIGH' THEN 1 END) AS hc
 FROM cases c LEFT JOIN (SELECT case_id, severity FROM rule_issues UNION ALL SELECT case_id, severity FROM conflicts
  UNION ALL SELECT case_id, severity FROM d0_issues) s USING (case_id) GROUP BY 1)""", ("rule_issues", "conflicts", "d0_issues"))
def cas8(spark, path):
    return c.validate(i.cases(spark, path), i.correlations(spark, path)).select(
        "case_id", "critical_count", "high_count", "issue_count", "status", "needs_review")


@query("CAS10", """SELECT case_id, classification, ihc_score, ish_group, confidence, guideline,
 coalesce(action_required, '') AS action, replace(steps, '|', ' → ') AS pathway FROM classified""", ("classified",))
def cas10(spark, path):
    return c.display(_classified(spark, path))


# ---- evidence --------------------------------------------------------------
@query("SRC9", """SELECT cl.classification, e.agent, e.eligible, e.context, e.trial, count(*) AS n
 FROM classified cl JOIN v_evidence e ON cl.classification = e.category GROUP BY ALL""", ("classified", "v_evidence"))
def src9(spark, path):
    cl = _classified(spark, path)
    return (cl.groupBy("classification").agg(F.count("*").alias("n"))
            .join(F.broadcast(v.evidence_df(spark).withColumnRenamed("category", "classification")), "classification")
            .select("classification", "agent", "eligible", "context", "trial", "n"))


# ---- routing ---------------------------------------------------------------
def _joined(name):
    return F.array_join(name, ",").alias(name)


@query("RTE1", "SELECT query_id, array_to_string(agents, ',') AS agents FROM keyword_routes", ("keyword_routes",))
def rte1(spark, path):
    return i.queries(spark, path).select("query_id", F.array_join(r.keyword_route(F.col("query"), F.col("has_case")), ",").alias("agents"))


@query("RTE2", "SELECT query_id, array_to_string(target_agents, ',') AS target_agents FROM routes", ("routes",))
def rte2(spark, path):
    return r.route(i.queries(spark, path)).select("query_id", _joined("target_agents"))


@query("RTE3", """SELECT query_id, array_to_string(p, ',') AS planned_agents, coalesce(p[1], 'synthesize') AS next_agent FROM (
 SELECT query_id, list_filter(target_agents, lambda a: NOT list_contains(ran, a))[1:3 - iteration] AS p FROM routes)""", ("routes",))
def rte3(spark, path):
    return r.next_step(r.route(i.queries(spark, path)), 3).select("query_id", _joined("planned_agents"), "next_agent")


@query("RTE4", """SELECT query_id, coalesce(min(CASE confidence WHEN 'HIGH' THEN 0.9::DOUBLE WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.3
 WHEN '' THEN NULL ELSE 0.5 END), 0.5)::DOUBLE AS confidence FROM agent_results GROUP BY 1""", ("agent_results",))
def rte4(spark, path):
    return r.synthesize(i.agent_results(spark, path)).select("query_id", "confidence")


@query("RTE5", """SELECT query_id, bool_or(agent = 'validation' AND coalesce(critical_count, 0) > 0) AS needs_review
 FROM agent_results GROUP BY 1""", ("agent_results",))
def rte5(spark, path):
    return r.synthesize(i.agent_results(spark, path)).select("query_id", "needs_review")


@query("RTE6", """SELECT query_id, string_agg('**' || upper(agent) || ':**' || chr(10) || narrative, chr(10) || chr(10) ORDER BY seq) AS answer
 FROM agent_results GROUP BY 1""", ("agent_results",))
def rte6(spark, path):
    return r.synthesize(i.agent_results(spark, path)).select("query_id", "answer")


# ---- grounding -------------------------------------------------------------
_vocab = sql_list([k.lower() for k in g.KNOWN_ENTITIES])


def _find(pattern, group=0):
    return f"regexp_extract_all(response, '(?i){pattern}', {group})"


_drift = " || ".join(_find(p) for p in g.DRIFT_PATTERNS)
_abs = ", ".join(f"regexp_extract(response, '(?i){p}')" for p in g.ABSOLUTE_PATTERNS)


def _m(pattern):
    return f"regexp_matches(response, '(?i){pattern}')"


def _q(text):
    return "'" + text.replace("'", "''") + "'"


table("grounded", f"""
SELECT *, h || '' AS hall_text, CASE WHEN t = 0 THEN 'CLEAN' WHEN t <= 2 THEN 'LOW' WHEN t <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
 least(0.5::DOUBLE, (nh * 10 + nv * 15) / 100.0::DOUBLE) AS penalty, nh = 0 AND nv = 0 AS is_grounded
FROM (SELECT *, nh * 2 + nv * 3 AS t FROM (
 SELECT response_id, array_to_string(list_sort(hl), '|') AS h, len(hl) AS nh, array_to_string(vl, '|') AS v, vl, hl, len(vl) AS nv, missing, flagged
 FROM (SELECT response_id,
  list_filter(list_distinct({_drift}), lambda x: NOT list_contains({_vocab}, lower(x)) AND NOT list_contains(context_labels, lower(x))) AS hl,
  (CASE WHEN {_m(g.NEGATIVE_PATTERN)} THEN [{_q(g.MSG_NEGATIVE)}] ELSE [] END)
  || list_transform(list_filter({_find(g.SCORE_PATTERN, 1)}, lambda s: s NOT IN ('3+', '2+', '1+', '0+', '0')), lambda s: 'Unknown IHC score referenced: ''' || s || '''')
  || (CASE WHEN has_case AND ihc_score = '3+' AND {_m(g.NON_POSITIVE_PATTERN)} THEN [{_q(g.MSG_NON_POSITIVE)}] ELSE [] END)
  || (CASE WHEN has_case AND ihc_score = '0' AND ish_group IS NULL AND {_m(g.THERAPY_PATTERN)} AND NOT {_m(g.EXPANDED_PATTERN)} THEN [{_q(g.MSG_THERAPY)}] ELSE [] END) AS vl,
  CASE WHEN len({_find(g.CLAIM_PATTERN)}) > 3 AND NOT {_m(g.CITATION_PATTERN)} THEN '{g.MSG_PROVENANCE}' ELSE '' END AS missing,
  array_to_string(list_filter([{_abs}], lambda x: x <> ''), '|') AS flagged
 FROM responses)))""", "responses")


def _checked(spark, path):
    return g.check(i.responses(spark, path))


@query("GND1", "SELECT response_id, h AS hallucinated FROM grounded", ("grounded",))
def gnd1(spark, path):
    return i.responses(spark, path).select(
        "response_id", F.array_join(F.array_sort(g.drift(F.col("response"), F.col("context_labels"))), "|").alias("hallucinated"))


@query("GND2", f"SELECT response_id, {_m(g.NEGATIVE_PATTERN)} AS deprecated FROM responses", ("responses",))
def gnd2(spark, path):
    return i.responses(spark, path).select("response_id", (F.size(g.category_claims(F.col("response"))) > 0).alias("deprecated"))


@query("GND3", f"""SELECT response_id, unnest(list_transform(list_filter({_find(g.SCORE_PATTERN, 1)}, lambda s: s NOT IN ('3+', '2+', '1+', '0+', '0')),
 lambda s: 'Unknown IHC score referenced: ''' || s || '''')) AS violation FROM responses""", ("responses",))
def gnd3(spark, path):
    return i.responses(spark, path).select("response_id", F.explode(g.score_claims(F.col("response"))).alias("violation"))


@query("GND4", f"""SELECT response_id, ihc_score = '3+' AND {_m(g.NON_POSITIVE_PATTERN)} AS non_positive,
 ihc_score = '0' AND ish_group IS NULL AND {_m(g.THERAPY_PATTERN)} AND NOT {_m(g.EXPANDED_PATTERN)} AS uncited_therapy FROM responses""", ("responses",))
def gnd4(spark, path):
    found = g.case_claims(F.col("response"), F.col("ihc_score"), F.col("ish_group"))
    return i.responses(spark, path).select(
        "response_id", F.array_contains(found, g.MSG_NON_POSITIVE).alias("non_positive"),
        F.array_contains(found, g.MSG_THERAPY).alias("uncited_therapy"))


@query("GND5", "SELECT response_id, missing AS missing_provenance FROM grounded", ("grounded",))
def gnd5(spark, path):
    return i.responses(spark, path).select("response_id", F.array_join(g.provenance(F.col("response")), "|").alias("missing_provenance"))


@query("GND6", "SELECT response_id, flagged FROM grounded", ("grounded",))
def gnd6(spark, path):
    return i.responses(spark, path).select("response_id", F.array_join(g.absolutes(F.col("response")), "|").alias("flagged"))


@query("GND7", "SELECT response_id, is_grounded, penalty, v AS violations FROM grounded", ("grounded",))
def gnd7(spark, path):
    return _checked(spark, path).select("response_id", "is_grounded", "penalty", F.array_join("violations", "|").alias("violations"))


@query("GND8", "SELECT response_id, severity FROM grounded", ("grounded",))
def gnd8(spark, path):
    return _checked(spark, path).select("response_id", "severity")


@query("GND9", r"""SELECT response_id, CASE WHEN is_grounded THEN '[GROUNDED] Response is fully grounded in the KG.' ELSE
 '[' || severity || '] Grounding issues detected:'
 || CASE WHEN nh > 0 THEN chr(10) || '  Hallucinated entities: [' || array_to_string(list_transform(list_sort(hl), lambda x: '''' || x || ''''), ', ') || ']' ELSE '' END
 || CASE WHEN nv > 0 THEN chr(10) || '  Clinical rule violations: [' || array_to_string(list_transform(vl, lambda x: CASE WHEN contains(x, '''') THEN '"' || x || '"' ELSE '''' || x || '''' END), ', ') || ']' ELSE '' END
 || CASE WHEN penalty > 0 THEN chr(10) || '  Confidence penalty: -' || round(penalty * 100)::INT || '%' ELSE '' END END AS summary FROM grounded""", ("grounded",))
def gnd9(spark, path):
    return _checked(spark, path).select("response_id", "summary")
