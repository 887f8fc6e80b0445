"""The whole pipeline against plain versions of its stages."""

import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import regex

import corpus_pipeline
from oncolattice.llm import pieces

from . import brute


def good(text):
    n, chars, symbols, dups, _, base = brute.quality(text)
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    unspaced = len(regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]", text or ""))
    different = sum(len(set(words[i:i + 200])) for i in range(0, n, 200))
    return not (base or 10 * symbols > n or 2 * dups > len(lines) or chars < 2 * n or (chars > 15 * n and 3 * unspaced < chars) or 10 * sum(c.isupper() for c in text) > 4 * chars
                or 2 * sum(any(c.isalpha() for c in w) for w in words) < n or 20 * different < n)


def private(docs, threshold=0.8, certainty=0.5):
    """Spans of each text: base findings and words that give their entities away."""
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found, places, n_t, n_e, n_et, kinds = [], [], Counter(), Counter(), Counter(), {}
    together = defaultdict(set)
    for _, text in docs:
        text = text or ""
        base = brute.base_personal(text)
        words = [(m.start(), m.end(), brute.lower(m[0])) for m in term.finditer(text)]
        n_t.update({w for *_, w in words})
        free = [(x, y, w) for x, y, w in words if not any(x < e and s < y for _, s, e in base)]
        own = {kind + (text[s:e].lower() if kind == "email" else re.sub("[^0-9.+]", "", text[s:e])) for kind, s, e in base}
        n_e.update(own)
        for pair in {(v, w) for v in own for *_, w in free}:
            n_et[pair] += 1
            together[pair].add(text)
        found.append(base)
        places.append(free)
    n = len(docs)
    for (v, w), both in n_et.items():
        d = len(together[v, w])
        if d > 1 and n_e[v] < n and both / n_t[w] * (d - 1) / d >= certainty and math.log(both / n_t[w] * (d - 1) / d * n / n_e[v]) / math.log(n / n_e[v]) >= threshold - 1e-12:
            kinds[w] = max(kinds.get(w, ""), "removed" if n_t[w] <= both else "general")
    return [[(s, e, k) for k, s, e in base] + [(s, e, kinds[w]) for s, e, w in free if w in kinds] for base, free in zip(found, places)]


def cleaned(text, spans):
    out, at = "", 0
    for s, e, k in sorted(spans):
        if e > at:
            word = text[s:e]
            form = "number" if re.search("[0-9]", word) else "name" if word[:1].isupper() else "word"
            out += text[at:max(at, s)] + ({"removed": "", "general": f"[{form}]"}.get(k, f"[{k}]") if s >= at else "")
            at = e
    return out + (text or "")[at:]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_run(spark, size):
    path = f"/root/testdata/{size}"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()]
    docs = [d for d in docs if good(d[1])]
    docs = [d for d, (i, _, root) in zip(docs, brute.near(docs, 5, 80)) if i == root]
    docs = [d for d, hit in zip(docs, brute.contamination(docs, items)) if not hit[-1]]
    want = {i: cleaned(t, s) for (i, t), s in zip(docs, private(docs))}
    rows = corpus_pipeline.run(spark, path)
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == want
    assert all(r.lossless for r in rows.select("lossless").distinct().collect())


def test_stages_are_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "encode"]
    assert corpus_pipeline.ORACLE_SQL is None
