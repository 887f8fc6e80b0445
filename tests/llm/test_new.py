"""SimHash trees, vector codes and periodic runs against plain versions, and their odd rows."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oncolattice.llm import codes, components, runs, simhash
from oncolattice.llm.queries import QUERIES, _with_repeats

from . import brute

BIG = "/root/testdata/sf0.01"
PROSE = "the quick brown fox jumps over the lazy dog while nine wizards boil seven toads near an old mill"


def documents(path):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]


def test_op11(spark):
    docs = documents(BIG)
    prints = brute.fingerprints(docs)
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, brute.close(docs, prints))]
    assert sorted(map(tuple, QUERIES["op11_simhash_near_dedup"](spark, BIG).collect())) == sorted(want)


def test_op12(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{BIG}/embeddings.parquet").to_pylist()]
    assert sorted(map(tuple, QUERIES["op12_vector_codes"](spark, BIG).collect())) == sorted(brute.codes(rows))


def test_op13(spark):
    want = [brute.run_row(d, w) for d, w in brute.with_repeats(documents(BIG)) if len(w) < 1500]
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, BIG).collect()}
    assert len(got) == len(documents(BIG)) and any(r[1] for r in want)
    for row in want:
        assert got[row[0]] == row


def near_points(rng, n):
    """Random fingerprints, some with a few bits changed, and a dense group."""
    far = rng.integers(0, 2**64, n, np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for _ in range(n)]
    dense = far[0] ^ np.array([(1 << i) | (1 << j) for i in range(40) for j in range(i)], np.uint64)
    return np.unique(np.concatenate([far, far ^ np.array(flips, np.uint64), dense]))


@pytest.mark.parametrize("shard, leaf", [(50, 16), (400, 64), (10**6, 10**6)])
def test_trees_find_all_pairs(spark, monkeypatch, shard, leaf):
    rng = np.random.default_rng(3)
    points = near_points(rng, 800)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long").repartition(5)
    links = simhash.close_links(frame, 3, shard, 600).collect()
    root = {int(p): int(p) for p in points.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    signed = points.view(np.int64)
    least = brute.close([(int(i), "") for i in signed], [int(p) for p in points])
    groups = {}
    for i in signed:
        groups.setdefault(find(int(i)), []).append(int(i))
    assert sorted(min(groups[find(int(i))]) for i in signed) == sorted(least)
    assert {int(i): min(groups[find(int(i))]) for i in signed} == dict(zip(map(int, signed), least))
    # the local tree, with leaves of any size
    monkeypatch.setattr(simhash, "LEAF", leaf)
    label = simhash._linked(points, np.arange(len(points)), np.zeros(0, np.int64), 3)
    assert len(set(label.tolist())) == len(set(least))


def test_points_nothing_parts():
    rng = np.random.default_rng(1)
    assert simhash._split(np.zeros(5, np.uint64), 3, rng) is None
    assert simhash.grow(np.zeros(0, np.uint64), 0, 3) == (0, 1)
    assert list(simhash.deal(0, np.zeros(0, np.uint64), 3)) == []


def test_simhash_odd_rows(spark):
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, PROSE), (5, PROSE), (None, PROSE.upper()), (8, "A b"), (9, "a  B"), (None, "alone here now"), (None, None), (12, "é ß 漢字 𝄞")]
    docs = spark.createDataFrame([(i, t, 0, "f") for i, t in rows], "doc_id long, text string, shard int, fingerprint string")
    got = [(r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = brute.fingerprints(rows)
    want = [(d, p, c) for (d, _), p, c in zip(rows, prints, brute.close(rows, prints))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 50, 1 << 18])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", block)
    rnd = random.Random(block)
    links = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for p in links if p[0] != p[1] for x in p}
    frame = spark.createDataFrame(links + [(None, 4), (7, 7)], "a long, b long").repartition(4)
    assert dict(map(tuple, components.components(frame, block).collect())) == want
    assert components.components(frame.limit(0), block).count() == 0


def test_codes_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(150)]
    rows += [(None, 1, rows[3][2]), (7, 2, rows[9][2]), (200, 1, None), (201, 1, []), (202, None, [None] * 16), (203, 1, [float("nan")] + [0.0] * 15),
             (204, 0, [float("-inf")] + [0.0] * 15), (205, 0, [-0.001] * 16), (206, 0, [1e4] * 16)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label long, embedding array<double>, error int, entries string").repartition(3)
    books = codes.learn(frame)
    coded = codes.with_group_error(codes.encode(frame, books, ["vec_id", "label"]), "label")
    want = brute.codes(rows)
    got = [(r.vec_id, "".join(f"{e:02x}" for e in r.entries), r.error, r.label_error) for r in coded.collect()]
    assert sorted(got, key=str) == sorted([w[:4] for w in want], key=str)
    assert brute.sha(",".join(map(str, books.ravel().tolist()))) == want[0][4]
    none = codes.learn(frame.limit(0))
    assert none.shape == (16, 0, 0) and codes.encode(frame.limit(0), none).count() == 0
    assert codes.encode(frame.where("vec_id >= 200 and vec_id < 205"), none).count() == 0
    few = frame.where("vec_id < 9")
    assert codes.learn(few).shape == (16, 10, 1)
    assert codes.encode(spark.createDataFrame([(1, [1e300] * 16), (2, [0.5] * 32)], "vec_id long, embedding array<double>"), books).collect()[0].error > 0


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8):
        x, book = rng.integers(-6, 6, (400, width)), rng.integers(-6, 6, (30, width))
        apart = ((x[:, None] - book[None]) ** 2).sum(2)
        index, best = codes.nearest(x, book)
        assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_runs_like_plain_ones():
    rnd = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            w = []
            while len(w) < rnd.randint(0, 150):
                part = [rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, rnd.choice([2, 6, 12])))]
                w += part * rnd.randint(1, 8) + part[:rnd.randint(0, len(part))]
            texts.append(w)
        ids = np.array([x for w in texts for x in w], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        for least, repeats in ((24, 3), (6, 3), (10, 4)):
            assert runs.runs_of(ids, offsets, least, repeats) == [brute.runs(w, least, repeats) for w in texts]


def test_runs_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 100)
    same, long = "a " * 50_000, " ".join(f"w{i % 7}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, long), (6, PROSE), (6, PROSE), (None, "x y z " * 9 + "q"), (8, "é 漢\x0b" * 20 + "end\x85  "), (9, "b " * 24), (10, "b " * 23)]
    docs = spark.createDataFrame([(i, t, "n", 1, "c", "r") for i, t in rows], "doc_id long, text string, best string, start int, kept string, length string")
    got = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs, keep=["doc_id", "best", "start", "kept", "length"]).collect()}
    assert got[4, 50_000].runs == [(0, 50_000, 1)] and got[4, 50_000].collapsed == "a"
    assert got[5, 40_000].runs == [(0, 40_000, 7)]
    assert got[1, 0].runs == [] and got[3, 0].collapsed == ""
    assert got[None, 28].runs == [(0, 27, 3)] and got[None, 28].collapsed == "x y z q"
    assert got[8, 42].runs == [(0, 40, 2)] and got[8, 42].collapsed == "é 漢 end\x85  "
    assert got[9, 24].runs == [(0, 24, 1)] and got[10, 23].runs == []
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    picked = runs.periodic_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    assert picked.where("doc_id = 4").first().best == (0, 50_000, 1) and picked.where("doc_id = 1").first().best is None


def test_repeats_are_made_as_stated(spark):
    rows = [(i, " ".join(f"{i}w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text or "").split() for r in _with_repeats(docs).collect()}
    assert got == dict(brute.with_repeats(rows))
