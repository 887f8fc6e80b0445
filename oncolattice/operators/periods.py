"""Statements with validity dates: supersession chains, non-overlapping periods, and what held as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = 16  # dyadic levels of days: 2^16 days are 179 years
FIRST, END = "1900-01-01", "2079-01-01"  # fixed values: the days that can be told apart


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST).cast("date")).cast("long")


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def guideline_periods(superseded: DataFrame) -> DataFrame:
    """Validity of guideline versions from ``superseded(src, dst, effective_date)``: (guideline, starts, ends).

    A version holds from the day it replaced another until the day it is replaced itself; with several replacements the first day
    counts. An open side is null. Both sides come from one aggregate.
    """
    rows = superseded.select(F.explode(F.array(
        F.struct(F.col("src").alias("guideline"), F.lit(None).cast("date").alias("starts"), F.col("effective_date").alias("ends")),
        F.struct(F.col("dst").alias("guideline"), F.col("effective_date").alias("starts"), F.lit(None).cast("date").alias("ends")))).alias("r")).select("r.*")
    return rows.filter(F.col("guideline").isNotNull()).groupBy("guideline").agg(F.min("starts").alias("starts"), F.min("ends").alias("ends"))


def periods(statements: DataFrame, key: list[str], guidelines: DataFrame | None = None) -> DataFrame:
    """Statements with ``valid_from``, ``valid_to`` (exclusive, null: open) and ``seq`` cut so that no two of one key overlap.

    A later statement about a key replaces earlier ones from its first day on, also after its own end; of one first day the highest seq
    counts. With ``guidelines`` a statement further holds only while the version named by its ``guideline`` does; a
    version never superseded, or none at all, sets no bound. Columns ``starts`` and ``ends`` (days) are added; empty periods are left out.
    """
    chain = Window.partitionBy(*key).orderBy("valid_from", "seq")
    rows = statements.filter(F.col("valid_from").isNotNull()).withColumn("_next", F.lead("valid_from").over(chain))
    rows = rows.withColumn("starts", F.col("valid_from").cast("date")).withColumn("ends", F.least(F.col("valid_to").cast("date"), F.col("_next").cast("date")))
    if guidelines is not None:
        bounds = guidelines.select("guideline", F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
        rows = rows.join(bounds, "guideline", "left").withColumn("starts", F.greatest("starts", "_starts")).withColumn("ends", F.least("ends", "_ends")).drop("_starts", "_ends")
    return rows.drop("_next").filter(F.col("ends").isNull() | (F.col("starts") < F.col("ends")))


def _blocks(starts: Column, ends: Column) -> Column:
    """The days [starts, ends) as aligned blocks of 1, 2, 4, ... days, at most two of each size: (level, block)."""
    def step(state, level):
        size = _size(level)
        a, b = state["a"], state["b"]
        odd_a, odd_b = (a < b) & (F.pmod(F.floor(a / size), F.lit(2)) == 1), (a < b) & (F.pmod(F.floor(b / size), F.lit(2)) == 1)
        low = F.when(odd_a, a + size).otherwise(a)
        odd_b = odd_b & (low < b)
        high = F.when(odd_b, b - size).otherwise(b)
        block = lambda at: F.struct(level.cast("int").alias("level"), F.floor(at / size).alias("block"))
        new = F.array_compact(F.array(F.when(odd_a, block(a)), F.when(odd_b, block(high))))
        return F.struct(low.alias("a"), high.alias("b"), F.concat(state["blocks"], new).alias("blocks"))
    zero = F.struct(starts.alias("a"), ends.alias("b"), F.array().cast("array<struct<level: int, block: bigint>>").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), zero, step, lambda s: s["blocks"])


def as_of(asked: DataFrame, held: DataFrame, on: list[str], at: str = "at") -> DataFrame:
    """Rows of ``asked`` with every row of ``held`` (starts, ends) that holds on their day, for equal ``on`` columns.

    A period is cut into at most two aligned blocks per size, and a day lies in one block of each size, so the range becomes equal keys:
    every pair meets exactly once, long periods make few rows, and the shuffle is by key and block, not by key
    alone. Both sides are many times their inputs, which size estimates do not see, so neither is ever broadcast. Days outside 1900 to 2078
    match nothing. Other columns of ``held`` are kept; they must not be named like those of ``asked``.
    """
    last = F.lit(END).cast("date")
    cut = held.withColumn("_b", F.explode(_blocks(F.greatest(_day(F.col("starts")), F.lit(0).cast("long")), _day(F.least(F.coalesce("ends", last), last)))))
    cut = cut.select(*held.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    day = _day(F.col(at).cast("date"))
    points = asked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("_block", F.floor(day / _size(F.col("_level"))))
    return points.hint("merge").join(cut.hint("merge"), [*on, "_level", "_block"]).drop("_level", "_block")
