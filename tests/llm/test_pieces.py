"""Merge-dropout draws anew for every occurrence of a word."""

import resource
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from oncolattice.llm import arrays, pieces, vocabulary


@pytest.fixture(scope="module")
def words():
    return vocabulary.load()


def ids(raw):
    return tuple(np.frombuffer(raw, np.int32).tolist())


def test_a_frequent_word_has_many_forms(words):
    n = 20_000
    encoder = pieces.Encoder(words, 3, 0.1)
    plain, taken = encoder.chunk(" international", [])
    keys = np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64)
    forms = Counter(map(ids, encoder.block([" international"] * n, keys)))
    assert len(forms) > 20
    same = sum(ids(encoder.chunk(" international", [k])[0]) == ids(plain) for k in range(taken))  # a skip need not change the pieces
    assert forms[ids(plain)] / n >= 0.9 ** taken - 0.015 and (same or abs(forms[ids(plain)] / n - 0.9 ** taken) < 0.015)
    for k in range(taken):  # every candidate is skipped somewhere
        assert ids(encoder.chunk(" international", [k])[0]) in forms
    text = " ".join(["international"] * 3000)
    whole = ids(encoder.text(text, 5))
    assert whole == ids(pieces.Encoder(words, 3, 0.1).text(text, 5)) != ids(encoder.text(text, 6))


def test_remembered_forms_are_those_of_the_single_run(words, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    encoder = pieces.Encoder(words, 1, 0.3)
    chunks = [" the", " unverhältnismäßig", " 🙂x", "▁a▁bc", " " * 7 + "indentation", "a" * 39, "b" * 90, " internationalization"] * 40
    keys = np.random.default_rng(1).integers(0, 2**63, len(chunks)).astype(np.uint64)
    want = [encoder.chunk(c, encoder.skips(int(k), 3 * len(c)))[0] for c, k in zip(chunks, keys)]
    for _ in range(2):
        assert encoder.block(chunks, keys) == want
    every = pieces.Encoder(words, 1, 1.0)
    assert every.block(chunks[:4], keys[:4]) == [every.chunk(c, range(200))[0] for c in chunks[:4]]


def test_pieces_are_handed_on_by_groups(words, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 100)
    texts = ["one two " * 9, None, "", "three four five " * 30, "six", "Été seven " * 12] * 4
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 24)], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(pieces._encoded(iter([batch.slice(0, 7), batch.slice(7)]), pieces.Encoder(words), pieces.Decoder(words)))
    assert len(parts) > 8 and all(p.num_rows for p in parts)
    rows = [r for p in parts for r in p.to_pylist()]
    single = pieces.Encoder(words)
    assert [(r["doc_id"], tuple(r["ids"])) for r in rows] == [(i or None, ids(single.text(t, i))) for i, t in enumerate(texts)]
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows)


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6


def test_a_worker_gives_free_memory_back():
    held = [np.ones(12_000) for _ in range(3000)]  # 96 kB each, too small for maps of their own
    last = held.pop()
    held.clear()
    before = _resident()
    arrays.hand_back()
    assert _resident() < before - 100 and len(last)
