"""Connected components of a table of links: blocks are solved locally, then joined by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import written

BLOCK = 1 << 18  # links that one task holds at once (16 bytes each)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; `label` leads every node straight to the smallest of its group, before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The smallest node of its group within these links for every node, itself included."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, at[:len(u)], at[len(u):])
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Links that join the same nodes, fewer of them: every block of links becomes stars around smallest nodes."""
    def run(batches):
        u, v, n = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                u.append(part.column(0).to_numpy())
                v.append(part.column(1).to_numpy())
                n += part.num_rows
                if n >= BLOCK:
                    yield _forest(np.concatenate(u), np.concatenate(v))
                    u, v, n = [], [], 0
        if n:
            yield _forest(np.concatenate(u), np.concatenate(v))

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links of longs -> (id, component) with the smallest id of the component; only linked ids appear.

    A task solves up to `block` links for itself and passes on one link a node. Where that leaves several tasks, a round
    hangs the neighbours of a node on the smallest of them; the minimum is a partial aggregate joined back, so a hub is
    never one task. Rounds grow with the logarithm of the longest chain between blocks. Null ends and self links are
    left out; an empty table gives an empty result.
    """
    edges = written(links.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    n, before = edges.count(), None
    while True:
        tasks = -(-n // block)
        if tasks <= 1:
            return written(_contracted(edges.coalesce(1)).toDF("id", "component"))
        edges = written(_contracted(edges.coalesce(tasks)).where("u != v").distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        n, before = now[0], now
