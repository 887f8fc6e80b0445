"""Registered queries: scoring matrix over tumour regions, rejection of assays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pick
from ..operators import decision as dec
from . import inputs as i
from .registry import query, sql_list, table, values

INTENSITY = ["Strong", "Moderate", "Weak", "Faint", "None", "unclear"]
CIRCUMFERENCE = ["Complete", "Incomplete", "Incomplete"]

table("regions", f"""SELECT l_orderkey AS case_id, {sql_list(INTENSITY)}[((l_partkey + l_linenumber) % 6 + 1)::INT] AS intensity,
 CASE WHEN l_suppkey % 7 <> 0 THEN {sql_list(CIRCUMFERENCE)}[(l_partkey % 3 + 1)::INT] END AS circumference, l_quantity::DOUBLE / 2 AS percent, (l_partkey % 50)::BIGINT AS cells FROM lineitem""")
table("matrix", values(dec.STAINING, ["a", "b", "p", "score", "category"]))


@query("DEC1", f"""SELECT case_id, max_by(score, lvl) AS score, max_by(category, lvl) AS category, sum(n)::BIGINT AS n_regions, coalesce(sum(n) FILTER (WHERE lvl IS NULL), 0)::BIGINT AS n_unscored,
  CASE WHEN sum(cells) FILTER (WHERE lvl IS NOT NULL) > 0 THEN string_agg(score || ' ' || (cells * 100 // nullif(total, 0))::BIGINT || '%', ', ' ORDER BY lvl DESC) FILTER (WHERE lvl IS NOT NULL) END AS shares
 FROM (SELECT *, sum(cells) FILTER (WHERE lvl IS NOT NULL) OVER (PARTITION BY case_id) AS total FROM (
  SELECT case_id, score, category, nullif(list_position({sql_list(dec.SCORES)}, score), 0) AS lvl, count(*) AS n, sum(cells) AS cells FROM regions r LEFT JOIN matrix m
   ON r.intensity = m.a AND (m.b IS NULL OR r.circumference = m.b) AND (m.p IS NULL OR (m.p = '>10') = (r.percent > 10)) GROUP BY 1, 2, 3)) GROUP BY 1""", ("regions", "matrix"))
def dec1(spark, path):
    """Orders as tumours whose line items are regions."""
    li = i.read(spark, path, "lineitem")
    return dec.score_regions(li.select(
        F.col("l_orderkey").alias("case_id"), pick(INTENSITY, F.col("l_partkey") + F.col("l_linenumber")).alias("intensity"),
        F.when(F.col("l_suppkey") % 7 != 0, pick(CIRCUMFERENCE, F.col("l_partkey"))).alias("circumference"),
        (F.col("l_quantity").cast("double") / 2).alias("percent"), (F.col("l_partkey") % 50).alias("cells")))


@query("DEC2", """SELECT assay_id, concat_ws(',', CASE WHEN event_id % 17 = 0 THEN 'controls' END, CASE WHEN user_id % 9 < 2 THEN 'invasive_areas' END, CASE WHEN weak > 25 THEN 'weak_signals' END,
  CASE WHEN event_id % 40 > 10 AND event_id % 4 = 0 THEN 'cytoplasmic_signals' END, CASE WHEN event_id % 23 = 0 THEN 'nuclear_resolution' END, CASE WHEN event_id % 29 = 0 THEN 'autofluorescence' END) AS reasons,
  CASE WHEN event_id % 4 <> 0 THEN 'cytoplasmic_signals' ELSE '' END AS unknown,
  CASE WHEN event_id % 17 = 0 OR user_id % 9 < 2 OR weak > 25 OR (event_id % 40 > 10 AND event_id % 4 = 0) OR event_id % 23 = 0 OR event_id % 29 = 0 THEN 'Indeterminate' ELSE 'Accepted' END AS outcome
 FROM (SELECT event_id AS assay_id, event_id, user_id, event_id * 7 % 31 AS weak FROM events)""")
def dec2(spark, path):
    """Events as probe assays."""
    e, u = F.col("event_id"), F.col("user_id")
    assays = i.read(spark, path, "events").select(
        e.alias("assay_id"), (e % 17 != 0).alias("controls_ok"), (u % 9).alias("invasive_areas"), (e * 7 % 31).alias("weak_percent"),
        F.when(e % 4 == 0, e % 40).alias("cytoplasm_percent"), (e % 23 == 0).alias("poor_resolution"), (e % 29 == 0).alias("autofluorescence"))
    return dec.reject_assays(assays).select("assay_id", F.concat_ws(",", "reasons").alias("reasons"), F.concat_ws(",", "unknown").alias("unknown"), "outcome")
