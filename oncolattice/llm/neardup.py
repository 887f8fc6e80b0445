"""MinHash near-duplicates by tensored banding.

A few collections of minhashes ("halves") are made per document; every pair of halves is the key of one
table, so h halves of r values give h(h-1)/2 tables of 2r values each, for about the square root of the
hashing that separate tables would take. Candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE, LOWER, SPACED, chunks, mix, number_hash, reduce_rows, text_bytes, word_hashes, words, written
from .components import components

ROWS = 2            # minhashes in a half
RARE = 16           # a shingle of at most so many sets of mixed buckets is rare; its owners are paired by it
MISS = 1e-5         # accepted chance that no table joins two documents of just the threshold
BROADCAST = 200_000  # so many ids (8 bytes) or pairs (16 bytes) may be broadcast; more are joined by a shuffle


def halves_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest halves of which at least two agree but for `miss`, at the threshold."""
    p, h = threshold ** rows, 2
    while (1 - p) ** h + h * p * (1 - p) ** (h - 1) > miss:
        h += 1
    return h


def _sets(column: pa.Array, k: int):
    """For row ranges of the column: first row, sorted distinct shingle hashes, offsets per row."""
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        at = offsets[first:last + 1] - offsets[first]
        low = LOWER[data[offsets[first]:offsets[last]]]
        starts, ends, row = words(low, at, SPACED)
        hashed = word_hashes(low, starts, ends)
        n_words = np.diff(row)
        counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        out = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        where = np.arange(out[-1]) - np.repeat(out[:-1], counts) + np.repeat(row[:-1], counts)
        shingle = np.zeros(len(where), np.uint64)
        length = np.repeat(np.minimum(n_words, k), counts)
        for j in range(k):
            more = j < length
            shingle[more] = mix(shingle[more] * np.uint64(BASE) + hashed[where[more] + j])
        for i in range(len(counts)):
            shingle[out[i]:out[i + 1]].sort()
        fresh = np.ones(len(shingle), bool)
        fresh[1:] = shingle[1:] != shingle[:-1]
        fresh[out[:-1][counts > 0]] = True
        shingle = shingle[fresh]
        yield first, shingle, np.concatenate([[0], np.cumsum(fresh)])[out]


def _set_id(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit id of each row's set; the empty set has none and gets 0."""
    one = reduce_rows(np.add, mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), at, 0)
    two = reduce_rows(np.bitwise_xor, mix(shingle * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), at, 0)
    return np.where(np.diff(at) > 0, mix(one + mix(two + np.diff(at).astype(np.uint64))), np.uint64(0))


def sketches(docs: DataFrame, k: int, n_halves: int, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id, halves."""
    factors = [(number_hash(2 * i + 1) | 1, number_hash(2 * i + 2)) for i in range(n_halves * rows)]

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for _, shingle, at in _sets(batch.column(1), k):
                halves = np.empty((len(at) - 1, n_halves), np.uint64)
                for h in range(n_halves):
                    value = np.full(len(at) - 1, h, np.uint64)
                    for a, b in factors[h * rows:(h + 1) * rows]:
                        value = mix(value * np.uint64(BASE) + reduce_rows(np.minimum, shingle * np.uint64(a) + np.uint64(b), at, 0))
                    halves[:, h] = value
                parts.append((np.diff(at), _set_id(shingle, at), halves))
            if not parts:
                continue
            n, sid, halves = (np.concatenate(x) for x in zip(*parts))
            flat = pa.array(halves.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_halves), flat)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sid.view(np.int64)), lists],
                                             ["doc_id", "n_shingles", "set_id", "halves"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_id long, halves array<long>")


def _full_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, shingle, at in _sets(batch.column(0), k):
                sid = _set_id(shingle, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid.view(np.int64)), pa.array([shingle[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    ["set_id", "shingles"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "set_id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs.select("a", "b").distinct())
    few = pairs.count() <= BROADCAST
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    if few:  # only the sets that are needed are shuffled, and once
        right = right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
    met = left.join(F.broadcast(pairs) if few else pairs, "a")
    return met.join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rare(sets: DataFrame, most: int) -> DataFrame:
    """(shingle, set_id, owners) for the shingles that at most `most` of the given sets have."""
    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int64))], ["set_id", "shingle"])

    rows = sets.select("set_id", "shingles").mapInArrow(run, "set_id long, shingle long")
    owners = rows.groupBy("shingle").agg(F.count("*").alias("owners")).where(F.col("owners") <= most)
    return rows.join(owners, "shingle")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the components g of set_id and cg of c; a set without links is its own."""
    member = found.select(F.col("id").alias("set_id"), F.col("component").alias("g"))
    owner = found.select(F.col("id").alias("c"), F.col("component").alias("cg"))
    return (rows.join(member, "set_id", "left").join(owner, "c", "left")
            .withColumn("g", F.coalesce("g", "set_id")).withColumn("cg", F.coalesce("cg", "c")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate component of every document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at white space; a set holds the distinct k-word shingles, or the
    whole sequence when it is shorter. Documents are linked when 100 * intersection >= percent * union.
    Null, empty and blank texts have the empty set, link with nothing and are their own component.
    Documents with equal sets are one node, whatever their number, so copies make no pairs. Rows that
    repeat a doc_id are each returned; a null doc_id takes part and gets the smallest id of its component,
    null if there is none. Other columns are ignored. An empty table gives an empty result.

    Three rounds find all links between components. First every member of a bucket is compared with the
    bucket's center. In buckets still holding several components it is then compared with another center, the one
    with the fewest shingles of its own, and last, members outside that center's component are compared
    with members of other components. Left out are pairs inside one component, which change nothing, and
    pairs that cannot be similar enough: sets of such buckets that share a rare shingle meet by it, and
    the others can only share the shingles that are not rare. A large group of loosely similar texts so makes few pairs.
    """
    n_halves = halves_for(percent / 100, rows, miss)
    made = written(sketches(docs, k, n_halves, rows, id_col, text_col))
    nodes = written(made.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves")))
    keys = F.array(*[F.struct(F.xxhash64(F.col("halves")[i], F.col("halves")[j], F.lit(64 * i + j)).alias("key"), F.lit(64 * i + j).alias("table"))
                     for i, j in combinations(range(n_halves), 2)])
    tables = nodes.select("set_id", "n", F.inline(keys))
    shared = tables.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    hits = written(tables.join(shared, "key").select("key", "table", "set_id", "n", "size"))
    # a bucket's center is the member that keeps most company over all tables: it links most of the others
    company = hits.groupBy("set_id").agg(F.sum("size").alias("company"))
    center = hits.join(company, "set_id").groupBy("key").agg(F.max(F.struct("company", "set_id", "n")).alias("c")).select(
        "key", F.col("c.set_id").alias("c"), F.col("c.n").alias("m"))
    hits = written(hits.join(center, "key").select("key", "table", "set_id", "n", "c", "m", "size"))

    first_ids = written(nodes.join(hits.select("set_id"), "set_id", "left_semi").select("first_id"))
    if first_ids.count() <= BROADCAST:
        first_ids = F.broadcast(first_ids)
    some = docs.join(first_ids, docs[id_col].cast("long").eqNullSafe(first_ids["first_id"]), "left_semi")
    sets = written(_full_sets(some, k, id_col, text_col))
    if sets.groupBy("set_id").count().where("count > 1").take(1):  # only where several rows have one id
        sets = written(sets.dropDuplicates(["set_id"]))

    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    star = hits.where(f"set_id != c and {near}").select(F.col("c").alias("a"), F.col("set_id").alias("b"))
    links = written(_confirmed(star, sets, percent))
    found = components(links)

    mixed = _labelled(hits.where("size > 2"), found)
    mixed = written(mixed.join(mixed.where("g != cg").select("key").distinct(), "key", "left_semi").select("key", "table", "set_id", "n"))
    rare = _rare(sets.join(mixed.select("set_id").distinct(), "set_id", "left_semi"), RARE)
    own = written(rare.groupBy("set_id").agg(F.count_if(F.col("owners") == 1).alias("unshared"), F.count("*").alias("rare")))
    # `most` shingles of a set are in another set here, `wide` in more than RARE sets; these bound the similarity of
    # every pair, and of every pair that has no rare shingle in common
    able = (mixed.join(own, "set_id", "left").withColumn("most", F.col("n") - F.coalesce("unshared", F.lit(0)))
            .withColumn("wide", F.col("n") - F.coalesce("rare", F.lit(0)))
            .where(f"100 * most >= {percent} * n").select("key", "table", "set_id", "n", "most", "wide"))
    enough = f"100 * least(most, most_b) >= {percent} * (n + m - least(most, most_b))"
    # now the center is the member with the fewest shingles of its own: a common origin, if it is there
    center = able.groupBy("key").agg(F.max(F.struct((F.col("most") - F.col("n")).alias("shared"), "set_id", "n", "most")).alias("x")).select(
        "key", F.col("x.set_id").alias("c"), F.col("x.n").alias("m"), F.col("x.most").alias("most_b"))
    able = written(able.join(center, "key"))
    star = able.where(f"set_id != c and {near} and {enough}").select(F.least("set_id", "c").alias("a"), F.greatest("set_id", "c").alias("b"))
    more = written(_confirmed(star, sets, percent))
    if more.take(1):
        links = links.union(more)
        found = components(links)

    group = _labelled(able.select("key", "table", "set_id", "n", "most", "wide", "c"), found)
    group = written(group.join(group.where("g != cg").select("key").distinct(), "key", "left_semi"))  # buckets that still hold several components
    pair = [F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")]
    left = group.select("set_id", "n", "most", "g").distinct().join(rare.where("owners > 1").select("shingle", "set_id"), "set_id")
    left = written(left.select("shingle", "set_id", "n", "most", "g")) if group.take(1) else left.limit(0)
    right = left.select("shingle", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("most").alias("most_b"), F.col("g").alias("h"))
    rest = left.join(right, "shingle").where(f"set_id < b and g != h and {near} and {enough}").select(*pair)
    broad = group.where(f"100 * wide >= {percent} * n")
    if broad.where("g != cg").take(1):
        halves = nodes.select("set_id", "halves").join(broad.select("set_id"), "set_id", "left_semi")
        broad = broad.join(broad.where("g != cg").select("key").distinct(), "key", "left_semi").join(halves, "set_id")
        outside = broad.where("g != cg").select("key", "table", "set_id", "n", "g", "wide", "halves")
        other = broad.where("set_id != c").select("key", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("g").alias("h"),
                                                  (F.col("g") != F.col("cg")).alias("out"), F.col("wide").alias("wide_b"), F.col("halves").alias("halves_b"))
        # a pair meets in many tables and is taken in the first, that of its first two equal halves
        once = f"slice(filter(sequence(0, {n_halves - 1}), i -> halves[i] = halves_b[i]), 1, 2) = array(cast(table div 64 as int), table % 64)"
        met = outside.join(other, "key").where(f"g != h and (not out or set_id < b) and {near} and {enough.replace('most', 'wide')} and {once}")
        rest = rest.union(met.select(*pair))
    more = written(_confirmed(rest, sets, percent))
    if more.take(1):
        found = components(links.union(more))

    labelled = (made.select("doc_id", "n_shingles", "set_id")
                .join(found.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
                .withColumn("component", F.coalesce("component", "set_id")))
    label = labelled.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    return (labelled.join(label, "component", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
