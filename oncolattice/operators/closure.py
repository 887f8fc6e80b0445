"""Class hierarchy closed under inheritance, and checks on what follows from it rather than on what is stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut, dealt


def superclasses(stated: DataFrame) -> DataFrame:
    """(sub, sup) pairs closed under transitivity; cycles are allowed, and a class in one is its own superclass.

    Semi-naive: a round extends only the pairs that are new since the last, by one stated step, and drops what is
    known. Rounds are as many as the hierarchy is deep.
    """
    step = cut(stated.select("sub", "sup").filter("sub is not null and sup is not null").distinct())
    known = fresh = step
    while not fresh.isEmpty():
        grown = fresh.join(step.select(F.col("sub").alias("sup"), F.col("sup").alias("_over")), "sup").select("sub", F.col("_over").alias("sup"))
        fresh = cut(grown.distinct().join(known, ["sub", "sup"], "left_anti"))
        known = known.unionByName(fresh)
    return known


def inherited(types: DataFrame, closed: DataFrame) -> DataFrame:
    """All classes of every individual of ``types(id, class)``, stated or inherited.

    Superclasses are put together per class first. An individual's classes then come from its own rows alone, so one row per stated
    class is shuffled, not one per inherited class, and none are compared in one large table.
    """
    up = closed.groupBy(F.col("sub").alias("class")).agg(F.collect_set("sup").alias("_over"))
    met = types.select("id", "class").filter("class is not null").join(up, "class", "left")
    classes = F.concat(F.array("class"), F.coalesce("_over", F.array().cast("array<string>")))
    return dealt(met.select("id", classes.alias("_all")), "id", rows=100_000, of=types).select("id", F.explode("_all").alias("class")).distinct()


def disjoint_conflicts(every: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Individuals in two classes declared disjoint by ``disjoint(a, b)``: (id, a, b) with a < b."""
    pairs = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left = every.withColumnRenamed("class", "a").join(pairs, "a")
    return left.join(every.withColumnRenamed("class", "b"), ["id", "b"]).select("id", "a", "b")


def cardinality_violations(every: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """Individuals whose class, stated or inherited, bounds the distinct ends of a predicate and that have too few or too many.

    ``limits(class, predicate, least, most)``; null sets no bound. Gives (id, class, predicate, n). An individual without
    any such edge counts as zero. Ends are counted once per individual and predicate, before classes multiply them.
    """
    wanted = edges.join(limits.select("predicate").distinct(), "predicate", "left_semi").select(F.col("src").alias("id"), "predicate", "dst").distinct()
    counted = wanted.groupBy("id", "predicate").agg(F.count("*").alias("n"))
    bound = every.join(limits, "class").join(counted, ["id", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return bound.filter((F.col("n") < F.col("least")) | (F.col("n") > F.col("most"))).select("id", "class", "predicate", "n")
