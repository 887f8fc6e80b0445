"""Keyword ranking, fusion, random walks and decision tables against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oncolattice.catalog import QUERIES, inputs
from oncolattice.operators import decision as dec, ranking as rk, vectors as vec, walks as wk


def bm25(texts, queries, k):
    words = {i: re.findall(rk.TERM, (t or "").lower()) for i, t in texts}
    average = max(sum(map(len, words.values())), 1) / max(len(words), 1)
    counts = {i: Counter(ws) for i, ws in words.items()}
    df = Counter(w for c in counts.values() for w in c)
    out = set()
    for q, text in queries:
        scores = Counter()
        for w in set(re.findall(rk.TERM, (text or "").lower())):
            for i, c in counts.items():
                if w in c:
                    idf = math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1.0)
                    scores[i] += math.floor(idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(words[i]) / average)) * 1e6 + 0.5)
        out |= {(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


@pytest.mark.parametrize("k, block", [(1, 3), (4, 3), (4, 1000), (500, 7)])
def test_keywords_equal_scoring_everything(spark, k, block):
    rnd = random.Random(k * block)
    vocabulary = ["the", "of", "a"] * 12 + ["her2", "ihc", "Été", "x1"] * 3 + [f"w{n}" for n in range(40)]
    texts = [(n, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 5, 30])))) for n in range(150)] + [(900, None), (901, ""), (902, "the " * 3000), (903, "w1, W1; w1")]
    queries = [(f"q{n}", " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 6])))) for n in range(25)] + [("none", None), ("empty", " .,"), ("absent", "nowhere"), ("twice", "w1 w1 the")]
    got = rk.keyword_top_k(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(queries, "query_id string, text string"), k, block=block)
    assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == bm25(texts, queries, k)


def test_keywords_of_empty_tables(spark):
    texts, queries = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert rk.keyword_top_k(texts.limit(0), queries).collect() == [] and rk.keyword_top_k(texts, queries.limit(0)).collect() == []
    stored = rk.inverted_index(texts)
    assert [r.id for r in rk.keyword_top_k(texts, queries, index=stored).collect()] == [1]


def fused(rankings, k):
    scores, n = defaultdict(Counter), defaultdict(Counter)
    for ranking in rankings:
        for q, i, rank in ranking:
            scores[q][i] += 10 ** 9 // (60 + rank)
            n[q][i] += 1
    return {(q, i, s, n[q][i], at + 1) for q, found in scores.items() for at, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])}


def test_keywords_and_vectors_fused(spark, sf):
    chunks = vec.chunk_texts(inputs.chunks(spark, sf))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'").collect()
    queries = [(str(r.conv_id * 100 + r.turn), r.text) for r in turns]
    none = chunks.select("id").limit(0)
    asked = spark.createDataFrame(queries, "id string, text string")
    have, want = ({r.id: np.array(r.embedding, float) for r in vec.embed_missing(t, none).collect()} for t in (chunks, asked))
    texts = {}
    for r in chunks.collect():  # of several texts of one id each takes part in the keyword ranking
        texts.setdefault(r.id, r.text)
    assert len(texts) == chunks.count()
    near = []
    for q, v in want.items():
        found = sorted(((-round(float(v @ u / np.linalg.norm(u) / np.linalg.norm(v)), 12), i) for i, u in have.items()))[:20]
        near += [(q, i, n + 1) for n, (_, i) in enumerate(found)]
    words = [(q, i, n) for q, i, _, n in bm25(texts.items(), queries, 20)]
    got = QUERIES["KWD2"](spark, sf).select("query_id", "id", "score", "found_in", "rank").collect()
    assert {tuple(r) for r in got} == fused([words, near], 5)


def push(edges, seeds, least, rounds):
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            links[a].add(b)
    out = {}
    for q in {q for q, _ in seeds}:
        start = {n for p, n in seeds if p == q and n is not None}
        left, mass = Counter({n: wk.UNIT // len(start) for n in start}), Counter()
        for _ in range(rounds):
            ready = [n for n in left if links.get(n) and left[n] >= least * len(links[n])]
            if not ready:
                break
            moved = Counter()
            for n in ready:
                each = left[n] * 85 // 100 // len(links[n])
                mass[n] += left.pop(n) - each * len(links[n])
                for to in links[n]:
                    moved[to] += each
            left.update(moved)
        for n in {*left, *mass}:
            ends = left[n] if not links.get(n) else 0
            out[q, n] = (mass[n] + ends, left[n] - ends)
    return out


def _graph():
    rnd = random.Random(3)
    edges = [(f"n{rnd.randint(0, 30)}", f"n{rnd.randint(0, 40)}") for _ in range(120)] + [("hub", f"n{n}") for n in range(40)] + [(f"n{n}", "hub") for n in range(0, 40, 3)]
    return edges + edges[:5] + [(None, "n1"), ("n1", None), ("loop", "loop")], [("a", "n1"), ("a", "n1"), ("a", "n2"), ("a", "n3"), ("b", "hub"), ("c", "loop"), ("d", "not there"), ("d", None)]


@pytest.mark.parametrize("least, rounds", [(10 ** 6, 5), (10 ** 9, 400), (3 * 10 ** 10, 400)])
def test_walks_equal_plain_push(spark, least, rounds):
    edges, seeds = _graph()
    rows = wk.personalised(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "query_id string, node string"), least, rounds=rounds).collect()
    got = {(r.query_id, r.node): (r.mass, r.residual) for r in rows if r.mass or r.residual}
    assert got == {k: v for k, v in push(edges, seeds, least, rounds).items() if any(v)}
    for q in "abcd":
        assert 0 <= wk.UNIT - sum(sum(v) for (p, _), v in got.items() if p == q) < 3


def test_walks_are_near_the_exact_rank(spark):
    edges, _ = _graph()
    rows = wk.personalised(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("b", "hub")], "query_id string, node string"), 10 ** 8).collect()
    links = defaultdict(set)
    for a, b in edges:
        if a and b:
            links[a].add(b)
    at, rank = {"hub": 1.0}, Counter()
    for _ in range(400):
        step = Counter()
        for n, m in at.items():
            to = links.get(n, ())
            rank[n] += m * 0.15 if to else m
            for x in to:
                step[x] += m * 0.85 / len(to)
        at = step
    open_ = sum(r.residual for r in rows) / wk.UNIT
    assert 0 < open_ < 0.05 and all(-1e-9 <= rank[r.node] - r.mass / wk.UNIT <= open_ + 1e-9 for r in rows)


def test_walks_without_edges_or_seeds(spark):
    edges, seeds = spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("q", "a")], "query_id string, node string")
    assert wk.personalised(edges, seeds.limit(0)).collect() == []
    assert [tuple(r) for r in wk.personalised(edges.limit(0), seeds).collect()] == [("q", "a", wk.UNIT, 0)]
    assert {r.node for r in wk.personalised(wk.both_ways(edges), seeds).collect()} == {"a", "b"}


def test_staining_matrix(spark):
    rows = [(a, b or x, {">10": v, "<=10": w}.get(p, v), s, c) for a, b, p, s, c in dec.STAINING for x in ("Complete", "Incomplete") for v, w in ((10.01, 10.0), (100.0, 0.0))]
    odd = [("Strong", "Complete", None, None, None), ("Strong", None, 50.0, None, None), (None, "Complete", 50.0, None, None), ("unclear", "Complete", 5.0, None, None), ("None", None, None, "0", "HER2_Null")]
    t = spark.createDataFrame(rows + odd, "intensity string, circumference string, percent double, want string, wanted string")
    for r in dec.decide(t, dec.STAINING_RULES).collect():
        assert (r.score, r.category) == (r.want, r.wanted) and r.n_rules == (r.want is not None)
    assert dec.audit(spark, dec.STAINING_RULES).collect() == []
    holes = [r for r in dec.STAINING_RULES if r.then != {"score": "3+", "category": "HER2_Positive"}] + [dec.Rule({"intensity": "Faint", "percent": dec.Span(50, 60)}, {"score": "x"})]
    found = {(r.intensity, r.circumference, r.percent, len(r.met)) for r in dec.audit(spark, holes).collect()}
    assert found == {("Strong", "Complete", p, 0) for p in (50.0, 60.0, 61.0)} | {("Faint", c, 60.0, 2) for c in ("Complete", "Incomplete")}


def test_regions_take_the_highest_score(spark):
    rows = [(1, "Weak", "Incomplete", 5.0, 30), (1, "Strong", "Complete", 40.0, 30), (1, "None", None, None, 30), (1, "odd", None, 1.0, 500), (1, "Strong", "Complete", 90.0, 1),
            (2, "odd", "Complete", 1.0, 5), (3, "Faint", "Complete", 20.0, None), (3, "Faint", "Complete", 20.0, -4), (None, "None", None, 0.0, 2)]
    got = dec.score_regions(spark.createDataFrame(rows, "case_id int, intensity string, circumference string, percent double, cells int"))
    assert {tuple(r) for r in got.collect()} == {(1, "3+", "HER2_Positive", 5, 1, "3+ 34%, 0+ 32%, 0 32%"), (2, None, None, 1, 1, None), (3, "1+", "HER2_Low", 2, 0, None), (None, "0", "HER2_Null", 1, 0, "0 100%")}


def test_rejected_assays(spark):
    rows = [(1, True, 2, 25, 10, False, False), (2, False, 1, 26, 11, True, True), (3, None, None, None, None, None, None), (4, True, 2, 25, 11, False, None)]
    got = {r.id: (r.outcome, r.reasons, len(r.unknown)) for r in dec.reject_assays(spark.createDataFrame(
        rows, "id int, controls_ok boolean, invasive_areas int, weak_percent int, cytoplasm_percent int, poor_resolution boolean, autofluorescence boolean")).collect()}
    assert got == {1: ("Accepted", [], 0), 2: ("Indeterminate", dec.REJECTIONS, 0), 3: ("Accepted", [], 6), 4: ("Indeterminate", ["cytoplasmic_signals"], 1)}


def test_pairs_of_texts_and_queries_are_no_rows(spark):
    texts = spark.range(40).select("id", F.lit("the of a").alias("text"))
    got = rk.keyword_top_k(texts, texts.withColumnRenamed("id", "query_id"), 2, block=10)
    assert {tuple(r) for r in got.select("query_id", "id", "rank").collect()} == {(q, i, i + 1) for q in range(40) for i in range(2)}
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_copies_for_cells_are_packed(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [(n, " ".join(rnd.choices([f"w{m}" for m in range(30)], k=12))) for n in range(60)] + [(3, "w1 w2 again")]  # an id may repeat
    queries = [(f"q{n}", " ".join(rnd.choices([f"w{m}" for m in range(30)], k=4))) for n in range(20)]
    seen = []
    inner = rk._best_of_cell

    def noted(k, fields):
        seen.append(fields)
        return inner(k, fields)
    monkeypatch.setattr(rk, "_best_of_cell", noted)
    got = rk.keyword_top_k(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "query_id string, text string"), 3, block=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert seen and "codes" in plan and "weights" in plan  # a row holds all codes of a text or a query
    assert got.select("query_id", "rank").distinct().count() == got.count() == 60
    coded = [r["code"] for r in rk._coded(spark.createDataFrame([(f"t{n}", n) for n in range(50)], "term string, df long").repartition(7)).collect()]
    assert sorted(coded) == list(range(50))
