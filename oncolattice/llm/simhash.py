"""SimHash near-duplicates by vantage-point trees.

A tree over a sample of fingerprints cuts the Hamming space into shards: a vantage point and a distance part each
node's fingerprints into an inside and an outside. Every fingerprint lives in one shard and is asked in all shards that
its ball overlaps, which the triangle inequality tells from the distance to each vantage point on the way. Within a
shard a tree over its own fingerprints goes on in the same manner down to small leaves, which are compared in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import written
from .components import components, unite

SEED = 42
RADIUS = 3
SHARD = 8192       # fingerprints that live in a shard, as far as the sample tells
SAMPLE = 1 << 17   # fingerprints the tree is made from (8 bytes each, on the driver)
LEAF = 256         # fingerprints compared in full
TRIES = 12         # vantage points tried for a node
CELLS = 1 << 20    # comparisons held at once
_SHINGLES = 1 << 16  # hashes held at once


def _fingerprint(text: bytes, k: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES):
        some = [digest(joined[s:e], SEED) for s, e in zip(starts[at:at + _SHINGLES], ends[at:at + _SHINGLES])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) of every row: the majority of each bit over the XXH64 of all k-word shingles."""
    def run(batches):
        for batch in batches:
            made = [_fingerprint((x.as_py() or "").encode(), k) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint long")


def _apart(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator):
    """A vantage point and a distance with few points near the border and halves of like size; None if nothing parts the points."""
    best = None
    for vantage in rng.choice(points, min(TRIES, len(points)), replace=False):
        counts = np.bincount(_apart(points[:4096], vantage), minlength=65)
        upto = np.cumsum(counts)
        if (counts > 0).sum() < 2:
            continue
        border = int(np.argmin(np.abs(2 * upto[:counts.nonzero()[0][-1]] - upto[-1])))
        if not upto[border]:
            border = int(counts.nonzero()[0][0])
        near = upto[min(border + radius, 64)] - (upto[border - radius] if border >= radius else 0)
        score = (near + abs(2 * upto[border] - upto[-1])) / upto[-1]
        if best is None or score < best[0]:
            best = (score, int(vantage), border)
    return best and best[1:]


def grow(sample: np.ndarray, total: int, radius: int, shard: int = SHARD):
    """Tree of (vantage, border, inside, outside); a leaf is the number of a shard. Also the number of shards."""
    rng, leaves = np.random.default_rng(7), 0
    share = total / max(1, len(sample))

    def node(points):
        nonlocal leaves
        parts = _split(points, radius, rng) if len(points) * share > shard and len(points) >= 16 else None
        if parts:
            inside = _apart(points, parts[0]) <= parts[1]
            if inside.any() and not inside.all():
                return (*parts, node(points[inside]), node(points[~inside]))
        leaves += 1
        return leaves - 1

    return node(sample), leaves


def _halves(points: np.ndarray, home: np.ndarray, asked: np.ndarray, vantage: int, border: int, radius: int):
    """What lives and is asked inside the border, and outside. A pair across it is found once: its inner end is asked outside."""
    at, ask = _apart(points[home], vantage), _apart(points[asked], vantage)
    edge = home[(at <= border) & (at > border - radius)]
    return (home[at <= border], asked[ask <= border + radius]), (home[at > border], np.concatenate([asked[ask > border - radius], edge]))


def deal(tree, points: np.ndarray, radius: int):
    """(shard, indexes that live there, indexes asked there) of the points for every shard that gets any."""
    todo = [(tree, np.arange(len(points)), np.zeros(0, np.int64))]
    while todo:
        node, home, asked = todo.pop()
        if not len(home) and not len(asked):
            continue
        if not isinstance(node, tuple):
            yield node, home, asked
            continue
        *parts, inside, outside = node
        todo += [(child, *half) for child, half in zip((inside, outside), _halves(points, home, asked, *parts, radius))]


def _linked(points: np.ndarray, home: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the points: equal where a chain of close pairs, each with an end in `home`, leads from one to the other."""
    label, rng = np.arange(len(points)), np.random.default_rng(11)
    todo = [(home, asked)]
    while todo:
        home, asked = todo.pop()
        if not len(home) or len(home) + len(asked) < 2:
            continue
        parts = _split(points[home], radius, rng) if len(home) > LEAF else None
        if parts:
            todo += _halves(points, home, asked, *parts, radius)
            continue
        step = max(1, CELLS // len(home))
        for rows in (home, asked):
            for first in range(0, len(rows), step):
                some = rows[first:first + step]
                a, b = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[home][None, :]) <= radius)
                a, b = some[a], home[b]
                unite(label, a[a != b], b[a != b])
    return label


def close_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b) links whose components are those of all pairs of distinct fingerprints with at most `radius` differing bits.

    `points` has one row per fingerprint (column fingerprint). A shard gives one link for each of its fingerprints at
    most, so a dense group gives no more links than members. The sample shapes the shards only; every pair is found with any sample.
    """
    total = points.count()
    share = F.pmod(F.xxhash64(F.col("fingerprint"), F.lit(SEED)), F.lit(1 << 30)) < math.ceil(min(1.0, sample / max(1, total)) * (1 << 30))
    taken = np.array([r[0] for r in points.where(share).collect()], np.int64).view(np.uint64)
    tree, _ = grow(np.sort(taken), total, radius, shard)

    def dealt(batches):
        for batch in batches:
            mine = batch.column(0).to_numpy().view(np.uint64)
            for number, home, asked in deal(tree, mine, radius):
                both = np.concatenate([home, asked])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), number, np.int32)), pa.array(mine[both].view(np.int64)),
                                                  pa.array(np.arange(len(both)) < len(home))], ["shard", "fingerprint", "home"])

    def solved(table):
        mine = table.column("fingerprint").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        label = _linked(mine, np.flatnonzero(home), np.flatnonzero(~home), radius)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(mine[label[far]].view(np.int64)), "b": pa.array(mine[far].view(np.int64))})

    rows = points.select("fingerprint").mapInArrow(dealt, "shard int, fingerprint long, home boolean")
    return rows.groupBy("shard").applyInArrow(solved, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
                    shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: components of fingerprints with at most `radius` differing bits.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a fingerprint bit is set if over half of the XXH64 values
    (seed 42, unsigned) of all space-joined k-word shingles, repeats included, have it; with fewer words the whole sequence is the one
    shingle. Null, empty and blank texts have fingerprint zero, which links like any other. component_id is the smallest
    doc_id reachable. Rows that repeat a doc_id are each returned; a null doc_id takes part and gets the smallest id of
    its component, null if there is none. Other columns are ignored. An empty table gives an empty result.
    Copies share a fingerprint, which is one point of the tree whatever their number.
    """
    made = written(fingerprints(docs, k, id_col, text_col))
    points = written(made.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    group = components(close_links(points, radius, shard, sample))
    named = points.join(group.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = written(named)
    least = written(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = named.join(least, "component").select("fingerprint", "component_id")
    return made.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
