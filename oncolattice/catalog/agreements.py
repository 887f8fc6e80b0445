"""Registered queries: agreement over several extraction passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as agr
from . import inputs as i
from .registry import query, table

PASSES, ROUNDS = 5, 6

table("votes", f"""SELECT l_orderkey * 10 + l_linenumber AS fact_id, 'r' || (l_suppkey % 7) AS predicate, p AS pass, ((l_quantity > 20) = ((l_orderkey * 7 + l_partkey * (p + 1) + p * p) % 10 >= p)) AS stated
 FROM lineitem, (SELECT unnest(range({PASSES})) AS p) WHERE (l_suppkey + p) % 6 <> 0""")


def _votes(spark, path):
    li = i.read(spark, path, "lineitem").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PASSES - 1).cast("long"))).alias("pass")).filter("(l_suppkey + pass) % 6 <> 0")
    p = F.col("pass")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("predicate"), "pass",
                     ((F.col("l_quantity") > 20) == ((F.col("l_orderkey") * 7 + F.col("l_partkey") * (p + 1) + p * p) % 10 >= p)).alias("stated"))


def _m(k):
    return f"""m{k} AS MATERIALIZED (SELECT predicate, pass, (sum(n * q * stated::INT) + 0.5::DOUBLE) / (sum(n * q) + 1) AS a, (sum(n * (1 - q) * stated::INT) + 0.5::DOUBLE) / (sum(n * (1 - q)) + 1) AS b, sum(n)::BIGINT AS n
 FROM cast_votes JOIN e{k} USING (predicate, pattern, n) GROUP BY 1, 2)"""


def _e(k):
    return f"""{_m(k)}, e{k + 1} AS MATERIALIZED (SELECT predicate, pattern, n, 1 / (1 + exp(-(told + ln(prior / (1 - prior))))) AS q FROM patterns JOIN (SELECT predicate, pattern, sum(CASE WHEN stated THEN ln(a / b) ELSE ln((1 - a) / (1 - b)) END) AS told
  FROM (SELECT predicate, pattern, pass, stated FROM cast_votes) JOIN m{k} USING (predicate, pass) GROUP BY 1, 2) USING (predicate, pattern) JOIN (SELECT predicate, (sum(n * q) + 0.5::DOUBLE) / (sum(n) + 1) AS prior FROM e{k} GROUP BY 1) USING (predicate))"""


_EM = """seen AS MATERIALIZED (SELECT fact_id, predicate, string_agg(pass || CASE WHEN stated THEN '+' ELSE '-' END, '' ORDER BY pass) AS pattern FROM (SELECT fact_id, predicate, pass, bool_or(stated) AS stated FROM votes GROUP BY 1, 2, 3) GROUP BY 1, 2),
 patterns AS MATERIALIZED (SELECT predicate, pattern, count(*) AS n FROM seen GROUP BY 1, 2),
 cast_votes AS MATERIALIZED (SELECT predicate, pattern, n, v[1]::BIGINT AS pass, v[2] = '+' AS stated FROM (SELECT *, unnest(regexp_extract_all(pattern, '..')) AS v FROM patterns)),
 e0 AS MATERIALIZED (SELECT predicate, pattern, n, len(replace(pattern, '+', '++')) * 1.0::DOUBLE / (len(pattern) / 2) - 2 AS q FROM patterns), """ + ", ".join(_e(k) for k in range(ROUNDS)) + f", {_m(ROUNDS)}"


@query("AGR1", f"""SELECT fact_id, predicate, len(pattern) // 2 AS n_passes, (len(replace(pattern, '+', '++')) - len(pattern))::BIGINT AS n_stated, round(q, 6) AS posterior
 FROM seen JOIN e{ROUNDS} USING (predicate, pattern)""", ("votes",), _EM)
def agr1(spark, path):
    """Line items as candidate facts of five passes, each of which saw most of them: how likely each fact is."""
    return agr.agreement(_votes(spark, path), ROUNDS)[0].withColumn("posterior", F.round("posterior", 6))


@query("AGR2", f"SELECT predicate, pass, round(a, 6) AS sensitivity, round(b, 6) AS false_rate, n FROM m{ROUNDS}", ("votes",), _EM)
def agr2(spark, path):
    """How reliable each pass is per predicate."""
    rows = agr.agreement(_votes(spark, path), ROUNDS)[1]
    return rows.withColumns({c: F.round(c, 6) for c in ("sensitivity", "false_rate")})
