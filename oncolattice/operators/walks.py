"""Personalised PageRank for many seed sets at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut

UNIT = 10 ** 12  # mass of one seed set; whole numbers, so sums are the same in any order


def personalised(edges: DataFrame, seeds: DataFrame, least: int = UNIT // 10 ** 6, stay: int = 15, rounds: int | None = None) -> DataFrame:
    """Rank of nodes as seen from ``seeds(query_id, node)`` over ``edges(src, dst)``: (query_id, node, mass, residual).

    A walk from a random seed ends at each node with a chance of ``stay`` percent, else follows a random link; it ends too
    where no link goes on. mass is the chance, in units of UNIT, that it ends at the node, without the walks that are
    still under way: residual, left at the node. Adding up: mass and residual of a query make UNIT, less what does not
    divide among its seeds. Parallel edges count once, rows with nulls and repeated seeds do not count.

    Forward push: a round moves on, for all queries together, the residual of nodes that hold at least ``least`` per link, and
    ends when there are none or after ``rounds``. A query can hold residual at no more than UNIT / least links that were
    pushed in a round, so its state is bounded whatever the size of the graph; a node with more than
    UNIT / least links is never pushed, and its links are left out beforehand, so no key of the join is hotter than that.
    """
    links = edges.select(F.col("src").alias("node"), "dst").filter("node is not null and dst is not null").distinct()
    degree = cut(links.groupBy("node").agg(F.count("*").alias("degree")))
    usable = degree.filter(F.col("degree") * least <= UNIT)
    links = cut(links.join(usable.select("node"), "node", "left_semi"))
    start = seeds.select("query_id", "node").filter("node is not null").distinct()
    share = start.groupBy("query_id").agg(F.expr(f"{UNIT}L div count(*)").alias("residual"))
    state = cut(start.join(share, "query_id").join(degree, "node", "left").select("query_id", "node", "residual", "degree"))
    ready = (F.col("degree") * least <= F.col("residual")) & F.col("degree").isNotNull()
    ended, done = [], 0
    while done != rounds and not state.filter(ready).isEmpty():
        pushed = state.filter(ready).withColumn("out", F.expr(f"residual * {100 - stay} div 100 div degree"))
        ended.append(pushed.select("query_id", "node", (F.col("residual") - F.col("out") * F.col("degree")).alias("mass")))
        moved = pushed.filter("out > 0").select("query_id", "node", "out").join(links, "node").select("query_id", F.col("dst").alias("node"), F.col("out").alias("residual"))
        kept = state.filter(~ready).select("query_id", "node", "residual")
        state = cut(kept.unionByName(moved).groupBy("query_id", "node").agg(F.sum("residual").alias("residual")).join(degree, "node", "left"))
        done += 1
    still = state.select("query_id", "node", F.when(F.col("degree").isNull(), F.col("residual")).otherwise(0).alias("mass"),
                         F.when(F.col("degree").isNull(), 0).otherwise(F.col("residual")).alias("residual"))
    rows = reduce(DataFrame.unionByName, [e.withColumn("residual", F.lit(0).cast("long")) for e in ended], still)
    return rows.groupBy("query_id", "node").agg(F.sum("mass").alias("mass"), F.sum("residual").alias("residual"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverse, for walks that may go against an edge."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
