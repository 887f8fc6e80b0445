"""Reliability of passes and posteriors of facts against a plain expectation-maximisation."""

import math
import random
from collections import defaultdict

import pytest

from oncolattice.operators.agreement import agreement

SCHEMA = "fact_id long, predicate string, pass string, stated boolean"


def plain(votes, rounds):
    seen = defaultdict(dict)
    for f, r, p, s in votes:
        if None not in (f, r, p, s):
            seen[f, r][p] = seen[f, r].get(p, False) or s
    q = {x: sum(v.values()) / len(v) for x, v in seen.items()}

    def learn():
        sums, prior = defaultdict(lambda: [0.0] * 5), defaultdict(lambda: [0.0, 0])
        for (f, r), v in seen.items():
            t = q[f, r]
            prior[r][0] += t
            prior[r][1] += 1
            for p, s in v.items():
                for at, x in enumerate((t, t * s, 1 - t, (1 - t) * s, 1)):
                    sums[r, p][at] += x
        return ({x: ((st + 0.5) / (t + 1), (sf + 0.5) / (u + 1), n) for x, (t, st, u, sf, n) in sums.items()}, {r: (t + 0.5) / (n + 1) for r, (t, n) in prior.items()})

    for _ in range(rounds):
        chances, prior = learn()
        for (f, r), v in seen.items():
            odds = math.log(prior[r] / (1 - prior[r]))
            for p, s in v.items():
                a, b, _n = chances[r, p]
                odds += math.log(a / b) if s else math.log((1 - a) / (1 - b))
            q[f, r] = 1 / (1 + math.exp(-odds))
    return q, learn()[0]


def _votes():
    rnd, truth, rows = random.Random(2), {}, []
    skill = {"p0": (0.95, 0.05), "p1": (0.9, 0.2), "p2": (0.6, 0.1), "p3": (0.5, 0.45)}
    for f in range(400):
        truth[f] = rnd.random() < 0.4
        for p, (hit, wrong) in skill.items():
            if rnd.random() < 0.9 or p == "p0":
                rows.append((f, "treats" if f % 3 else "defines", p, rnd.random() < (hit if truth[f] else wrong)))
    return truth, rows


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_equal_to_plain(spark, rounds):
    _, rows = _votes()
    rows += [(1, "treats", "p1", True), (1, "treats", "p1", False), (7, "both", "p0", True), (None, "treats", "p1", True), (3, None, "p1", True), (3, "treats", None, True), (3, "treats", "p1", None)]
    facts, passes = agreement(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds)
    q, chances = plain(rows, rounds)
    got = {(r.fact_id, r.predicate): r.posterior for r in facts.collect()}
    assert got.keys() == q.keys() and all(abs(got[x] - q[x]) < 1e-9 for x in q)
    have = {(r.predicate, r["pass"]): (r.sensitivity, r.false_rate, r.n) for r in passes.collect()}
    assert have.keys() == chances.keys() and all(max(abs(a - b) for a, b in zip(have[x], chances[x])) < 1e-9 for x in have)


def test_learns_who_to_trust(spark):
    truth, rows = _votes()
    facts, passes = agreement(spark.createDataFrame(rows, SCHEMA))
    got = facts.collect()
    right = sum((r.posterior > 0.5) == truth[r.fact_id] for r in got)
    voted = sum((2 * r.n_stated > r.n_passes) == truth[r.fact_id] for r in got)
    assert right > 370 and right > voted
    trust = {r["pass"]: r.sensitivity - r.false_rate for r in passes.filter("predicate = 'treats'").collect()}
    assert trust["p0"] > trust["p2"] > trust["p3"]


def test_no_votes(spark):
    facts, passes = agreement(spark.createDataFrame([], SCHEMA), 2)
    assert facts.collect() == [] and passes.collect() == []
