"""Periods, dates and class closure against plain versions."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from oncolattice.operators import closure, periods


def test_as_of_meets_every_pair_once(spark):
    rnd = random.Random(4)
    day = lambda n: date(2000, 1, 1) + timedelta(days=n)
    starts = [rnd.randint(-40000, 20000) for _ in range(60)]
    held = [(rnd.choice("ab"), k, day(s), rnd.choice([None, day(s + rnd.randint(1, 9000)), day(s + 1)])) for k, s in enumerate(starts)]
    held += [("a", 900, day(0), day(0)), (None, 901, day(0), None)]
    asked = [(n, rnd.choice("abc"), day(rnd.randint(-36000, 28000))) for n in range(300)] + [(900, "a", None)]
    h = spark.createDataFrame(held, "k string, no int, starts date, ends date")
    q = spark.createDataFrame(asked, "n int, k string, at date")
    got = sorted((r.n, r.no) for r in periods.as_of(q, h, ["k"]).collect())
    low, high = date(1900, 1, 1), date(2079, 1, 1)
    want = sorted((n, no) for n, k, at in asked for k2, no, s, e in held if k == k2 and at and low <= at < high and s <= at and (e is None or at < e))
    assert got == want and len(got) > 300


def test_periods_do_not_overlap(spark):
    d = lambda m: date(2020, m, 1)
    rows = [("x", 1, d(1), None, "g1"), ("x", 2, d(3), d(5), "g1"), ("x", 3, d(3), d(4), "g2"), ("x", 4, d(9), None, None), ("y", 5, d(2), d(2), None), ("z", 6, None, None, None)]
    s = spark.createDataFrame(rows, "k string, seq int, valid_from date, valid_to date, guideline string")
    chain = spark.createDataFrame([("g1", "g2", d(2)), ("g2", "g3", d(12)), ("g2", "g4", d(11))], "src string, dst string, effective_date date")
    assert {(r.guideline, r.starts, r.ends) for r in periods.guideline_periods(chain).collect()} == {
        ("g1", None, d(2)), ("g2", d(2), d(11)), ("g3", d(12), None), ("g4", d(11), None)}
    plain = {(r.seq, r.starts, r.ends) for r in periods.periods(s, ["k"]).collect()}
    assert plain == {(1, d(1), d(3)), (3, d(3), d(4)), (4, d(9), None)}
    bound = {(r.seq, r.starts, r.ends) for r in periods.periods(s, ["k"], periods.guideline_periods(chain)).collect()}
    assert bound == {(1, d(1), d(2)), (3, d(3), d(4)), (4, d(9), None)}


def test_closure_with_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("x", None)]
    got = {tuple(r) for r in closure.superclasses(spark.createDataFrame(pairs, "sub string, sup string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "b"), ("c", "b"), ("c", "c"), ("d", "a"), ("d", "b"), ("d", "c")}
    types = spark.createDataFrame([("i", "a"), ("j", "d"), ("j", "z"), ("k", None)], "id string, class string")
    every = closure.inherited(types, spark.createDataFrame(list(got), "sub string, sup string"))
    assert {tuple(r) for r in every.collect()} == {("i", "a"), ("i", "b"), ("i", "c"), ("j", "d"), ("j", "a"), ("j", "b"), ("j", "c"), ("j", "z")}
    wrong = closure.disjoint_conflicts(every, spark.createDataFrame([("z", "c"), ("q", "c"), ("c", "c")], "a string, b string"))
    assert {tuple(r) for r in wrong.collect()} == {("j", "c", "z")}
    edges = spark.createDataFrame([("i", "p", "1"), ("i", "p", "1"), ("i", "p", "2"), ("i", "q", "3")], "src string, predicate string, dst string")
    limits = spark.createDataFrame([("c", "p", 1, 1), ("z", "p", None, 0)], "class string, predicate string, least int, most int")
    assert {tuple(r) for r in closure.cardinality_violations(every, edges, limits).collect()} == {("i", "c", "p", 2), ("j", "c", "p", 0)}


def test_neither_side_of_as_of_is_broadcast(spark):
    d = date(2020, 1, 1)
    asked = spark.createDataFrame([("x", d)], "k string, at date")
    held = spark.createDataFrame([("x", d, None)], "k string, starts date, ends date")
    met = periods.as_of(asked, held, ["k"])
    assert met.count() == 1 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_classes_are_dealt_by_individual(spark):
    types = spark.range(0, 900, 1, 2).selectExpr("concat('o', id % 450) AS id", "concat('c', id % 3) AS class").unionByName(spark.createDataFrame([("o1", None), (None, "c0")], "id string, class string"))
    closed = spark.createDataFrame([("c0", "n"), ("c1", "n"), ("n", "r"), ("c0", "r"), ("c1", "r"), ("n", "n")], "sub string, sup string")
    every = closure.inherited(types, closed)
    got = sorted((r["id"] or "", r["class"]) for r in every.collect())
    want = {(f"o{k}", c) for k in range(450) for c in ([f"c{k % 3}"] + (["n", "r"] if k % 3 < 2 else []))} | {("", "c0"), ("", "n"), ("", "r")}
    assert got == sorted(want)
    assert "Union" not in every._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # no table of all inherited rows beside the stated ones


def test_tasks_grow_with_the_rows(spark, sf):
    from oncolattice.catalog import inputs
    from oncolattice.session import dealt
    rows = spark.range(1000).withColumn("k", F.col("id") % 500)
    assert [dealt(rows, "k", rows=n).rdd.getNumPartitions() for n in (1000, 100, 10)] == [4, 10, 100]
    assert dealt(rows, "k", rows=50).groupBy("k").count().count() == 500
    assert "RepartitionByExpression" in inputs.eligibility(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
