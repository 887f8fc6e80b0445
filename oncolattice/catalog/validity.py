"""Registered queries: validity over time, class closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as cl, periods as pr
from . import inputs as i
from .registry import query, table

_LIVES = """periods AS (SELECT src, dst, predicate, greatest(f, starts) AS starts, CASE WHEN t IS NULL OR ends IS NULL THEN coalesce(t, ends) ELSE least(t, ends) END AS ends
 FROM (SELECT src, dst, predicate, guideline, valid_from AS f, least(valid_to, coalesce(lead(valid_from) OVER (PARTITION BY src, dst ORDER BY valid_from, seq), valid_to)) AS t FROM statements) LEFT JOIN
 (SELECT guideline, min(s) AS starts, min(e) AS ends FROM (SELECT src AS guideline, NULL::DATE AS s, effective_date AS e FROM superseded UNION ALL SELECT dst, effective_date, NULL FROM superseded) GROUP BY 1) g USING (guideline))"""

table("superseded", "SELECT 'G' || n_nationkey AS src, 'G' || (n_nationkey + 1) AS dst, DATE '1993-01-01' + (n_nationkey * 80)::INT AS effective_date FROM nation WHERE n_nationkey % 3 < 2")
table("statements", """SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'notEligibleFor' ELSE 'eligibleFor' END AS predicate, 'G' || (l_orderkey % 40) AS guideline,
 l_shipdate::DATE AS valid_from, l_shipdate::DATE + (l_quantity * 20)::INT AS valid_to, l_orderkey * 100 + l_linenumber AS seq FROM lineitem""")
table("asked_days", "SELECT event_id, 'S' || (user_id % (SELECT max(s_suppkey) + 1 FROM supplier)) AS src, DATE '1992-01-01' + (event_id * 7 % 2600)::INT AS at FROM events")


def _statements(spark, path):
    li = i.read(spark, path, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return li.select(i._id("S", "l_suppkey").alias("src"), i._id("P", "l_partkey").alias("dst"),
                     F.when(F.col("l_returnflag") == "R", "notEligibleFor").otherwise("eligibleFor").alias("predicate"),
                     F.concat(F.lit("G"), (F.col("l_orderkey") % 40).cast("string")).alias("guideline"), day.alias("valid_from"),
                     F.date_add(day, (F.col("l_quantity") * 20).cast("int")).alias("valid_to"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))


def _periods(spark, path):
    n = F.col("n_nationkey")
    chain = i.read(spark, path, "nation").filter(n % 3 < 2).select(
        F.concat(F.lit("G"), n.cast("string")).alias("src"), F.concat(F.lit("G"), (n + 1).cast("string")).alias("dst"),
        F.date_add(F.lit("1993-01-01").cast("date"), (n * 80).cast("int")).alias("effective_date"))
    return pr.periods(_statements(spark, path), ["src", "dst"], pr.guideline_periods(chain))


@query("TMP1", "SELECT src, dst, predicate, strftime(starts, '%Y-%m-%d') AS starts, strftime(ends, '%Y-%m-%d') AS ends FROM periods WHERE starts < ends", ("superseded", "statements"), _LIVES)
def tmp1(spark, path):
    """Line items as dated statements, cut into periods by later statements and by guideline versions."""
    return _periods(spark, path).select("src", "dst", "predicate", F.col("starts").cast("string").alias("starts"), F.col("ends").cast("string").alias("ends"))


@query("TMP2", """SELECT event_id, count(dst) FILTER (WHERE predicate = 'eligibleFor') AS eligible, count(dst) FILTER (WHERE predicate = 'notEligibleFor') AS not_eligible, min(dst) AS first_agent
 FROM asked_days a LEFT JOIN periods p ON p.src = a.src AND a.at >= p.starts AND a.at < p.ends GROUP BY 1""", ("superseded", "statements", "asked_days"), _LIVES)
def tmp2(spark, path):
    """Eligibility as of the day of every event."""
    e = i.read(spark, path, "events").select("event_id", F.concat(F.lit("S"), (F.col("user_id") % i.key_range(spark, path, "supplier", "s_suppkey")).cast("string")).alias("src"),
                                             F.date_add(F.lit("1992-01-01").cast("date"), (F.col("event_id") * 7 % 2600).cast("int")).alias("at"))
    met = pr.as_of(e, _periods(spark, path).select("src", "dst", "predicate", "starts", "ends"), ["src"])
    per = met.groupBy("event_id").agg(F.count_if(F.col("predicate") == "eligibleFor").alias("eligible"), F.count_if(F.col("predicate") == "notEligibleFor").alias("not_eligible"),
                                      F.min("dst").alias("first_agent"))
    return e.select("event_id").join(per, "event_id", "left").fillna(0, ["eligible", "not_eligible"])


# ---- class closure -------------------------------------------------------------
table("sub_classes", """SELECT 'C' || c_custkey AS sub, 'N' || c_nationkey AS sup FROM customer UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
 UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'R' || ((r_regionkey + 3) % 6) FROM region WHERE r_regionkey % 3 = 0""")
table("closed", "SELECT sub, sup FROM sub_classes UNION SELECT c.sub, s.sup FROM closed c JOIN sub_classes s ON s.sub = c.sup", "sub_classes")
table("stated_types", "SELECT 'O' || o_orderkey AS id, 'C' || o_custkey AS class FROM orders UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem WHERE l_linenumber = 1")
table("every_type", "SELECT id, class FROM stated_types UNION SELECT t.id, c.sup FROM stated_types t JOIN closed c ON c.sub = t.class", "stated_types", "closed")


def _closed(spark, path):
    def pairs(name, a, sub, b, sup):
        return i.read(spark, path, name).select(i._id(a, sub).alias("sub"), i._id(b, sup).alias("sup"))
    r = F.col("r_regionkey")
    loop = i.read(spark, path, "region").filter(r % 3 == 0).select(i._id("R", "r_regionkey").alias("sub"), F.concat(F.lit("R"), ((r + 3) % 6).cast("string")).alias("sup"))
    return cl.superclasses(pairs("customer", "C", "c_custkey", "N", "c_nationkey").unionByName(pairs("supplier", "S", "s_suppkey", "N", "s_nationkey"))
                           .unionByName(pairs("nation", "N", "n_nationkey", "R", "n_regionkey")).unionByName(loop))


def _every(spark, path):
    types = i.read(spark, path, "orders").select(i._id("O", "o_orderkey").alias("id"), i._id("C", "o_custkey").alias("class")).unionByName(
        i.read(spark, path, "lineitem").filter("l_linenumber = 1").select(i._id("O", "l_orderkey").alias("id"), i._id("S", "l_suppkey").alias("class")))
    return cl.inherited(types, _closed(spark, path))


@query("CLS1", "SELECT sub, sup FROM closed", ("closed",))
def cls1(spark, path):
    return _closed(spark, path)


@query("CLS2", "SELECT x.id, x.class AS a, y.class AS b FROM every_type x JOIN every_type y ON x.id = y.id AND (x.class, y.class) IN (('R0', 'R1'), ('R2', 'R3'))", ("every_type",))
def cls2(spark, path):
    """Orders whose customer and supplier lie, by inheritance, in regions declared disjoint."""
    return cl.disjoint_conflicts(_every(spark, path), spark.createDataFrame([("R1", "R0"), ("R2", "R3")], "a string, b string"))


@query("CLS3", """SELECT e.id, e.class, 'contains' AS predicate, coalesce(n, 0) AS n FROM every_type e LEFT JOIN (SELECT 'O' || l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) l USING (id)
 WHERE (e.class = 'R0' AND (coalesce(n, 0) < 2 OR coalesce(n, 0) > 6)) OR (e.class = 'N3' AND coalesce(n, 0) > 3)""", ("every_type",))
def cls3(spark, path):
    """Orders with too few or too many parts for a class they inherit."""
    edges = i.read(spark, path, "lineitem").select(i._id("O", "l_orderkey").alias("src"), F.lit("contains").alias("predicate"), i._id("P", "l_partkey").alias("dst"))
    limits = spark.createDataFrame([("R0", "contains", 2, 6), ("N3", "contains", None, 3)], "class string, predicate string, least int, most int")
    return cl.cardinality_violations(_every(spark, path), edges, limits)
