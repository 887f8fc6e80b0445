"""Agreement over several extraction passes: how reliable each pass is, and how likely each fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut, dealt

ROUNDS = 20


def _odds(p):
    return F.log(p / (1.0 - p))


def agreement(votes: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Posterior of facts and reliability of passes from ``votes(fact_id, predicate, pass, stated)`` by expectation-maximisation.

    A vote says whether a pass that read the place of a candidate fact stated it. Gives
    (fact_id, predicate, n_passes, n_stated, posterior) and (predicate, pass, sensitivity, false_rate, n), n being votes. Each pass has,
    per predicate, a chance to state what is true and one to state what is not; passes err apart from each other.
    The start is the share of passes that state the fact; counts are smoothed by half a vote on each side. Repeated votes of a pass on a
    fact are one, stated if any is; votes with a null do not count.

    Facts that drew the same votes have the same posterior. They are counted together first, so rounds run over patterns of
    votes, at most 3 ** passes per predicate whatever the number of facts, and facts are read twice only. Votes are
    shuffled once, by fact: both of the groupings that make a pattern go on from there.
    """
    given = votes.filter("fact_id is not null and predicate is not null and pass is not null and stated is not null")
    one = dealt(given, "fact_id", "predicate").groupBy("fact_id", "predicate", "pass").agg(F.bool_or("stated").alias("stated"))
    seen = cut(one.groupBy("fact_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("pass", "stated"))).alias("pattern")))
    patterns = cut(seen.groupBy("predicate", "pattern").agg(F.count("*").alias("n")))
    cast = cut(patterns.select("predicate", "pattern", "n", F.explode("pattern").alias("vote")).select("predicate", "pattern", "n", "vote.pass", "vote.stated"))
    yes = F.size(F.filter("pattern", lambda v: v["stated"])).cast("long")
    believed = patterns.select("predicate", "pattern", "n", (yes / F.size("pattern")).alias("q"))
    for _ in range(rounds):
        believed = cut(_believe(patterns, cast, *_reliability(cast, believed)))
    passes, _ = _reliability(cast, believed)
    facts = seen.join(believed.select("predicate", "pattern", "q"), ["predicate", "pattern"]).select(
        "fact_id", "predicate", F.size("pattern").cast("long").alias("n_passes"), yes.alias("n_stated"), F.col("q").alias("posterior"))
    return facts, passes.select("predicate", "pass", "sensitivity", "false_rate", "n")


def _reliability(cast: DataFrame, believed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chances of every pass, and the share of true facts per predicate."""
    true, false = F.col("n") * F.col("q"), F.col("n") * (1.0 - F.col("q"))
    said = F.col("stated").cast("double")
    passes = cast.join(believed.select("predicate", "pattern", "q"), ["predicate", "pattern"]).groupBy("predicate", "pass").agg(
        ((F.sum(true * said) + 0.5) / (F.sum(true) + 1.0)).alias("sensitivity"), ((F.sum(false * said) + 0.5) / (F.sum(false) + 1.0)).alias("false_rate"), F.sum("n").alias("n"))
    return passes, believed.groupBy("predicate").agg(((F.sum(true) + 0.5) / (F.sum("n") + 1.0)).alias("prior"))


def _believe(patterns: DataFrame, cast: DataFrame, passes: DataFrame, prior: DataFrame) -> DataFrame:
    """Posterior of every pattern under the given chances."""
    a, b = F.col("sensitivity"), F.col("false_rate")
    told = cast.join(passes.select("predicate", "pass", "sensitivity", "false_rate"), ["predicate", "pass"]).groupBy("predicate", "pattern").agg(
        F.sum(F.when(F.col("stated"), F.log(a / b)).otherwise(F.log((1.0 - a) / (1.0 - b)))).alias("told"))
    both = patterns.join(told, ["predicate", "pattern"]).join(prior, "predicate")
    return both.select("predicate", "pattern", "n", (1.0 / (1.0 + F.exp(-(F.col("told") + _odds(F.col("prior")))))).alias("q"))
