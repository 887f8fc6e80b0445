"""The registered queries against plain versions, over whole tables."""

import re

import duckdb
import pyarrow.parquet as pq
import pytest

from oncolattice.llm import language, neardup, suffixes, vocabulary
from oncolattice.llm.queries import ORACLE, QUERIES

from . import brute

BIG = "/root/testdata/sf0.01"


def table(path, name="documents"):
    return pq.read_table(f"{path}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return table(BIG)


def got(spark, key, path=BIG):
    return [r.asDict() for r in QUERIES[key](spark, path).collect()]


def test_op1(spark, docs):
    rows = {r["doc_id"]: r for r in got(spark, "op1_secret_scans")}
    assert len(rows) == len(docs)
    for d in docs:
        found, r = brute.base_secrets(d["text"]), rows[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in found) for x in ("assign", "access", "hex"))
        assert r["base_sha256"] == brute.sha(brute.joined(found))
        assert set(brute.joined(found).split(",")) <= set(r["spans"].split(",")) | {""}


def test_op2(spark, docs):
    from tokenizers import Tokenizer, decoders, models, normalizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    # controls are no pieces of texts
    plain = Tokenizer(models.Unigram([p if i > 2 else (f"\0{i}", -1e9) for i, p in enumerate(pieces)], unk_id=0, byte_fallback=True))
    plain.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for r in got(spark, "op2_token_counts"):
        text = docs[r["doc_id"]]["text"]
        if len(text) < 3000:
            assert r["n_tokens"] == len(plain.encode(text, add_special_tokens=False).ids), r


def test_op3(spark, docs):
    rows = {r["doc_id"]: r for r in got(spark, "op3_quality_rules")}
    labels = {r["doc_id"]: r["quality"] for r in table(BIG, "labels")}
    clean = [0, 0]
    for d in docs:
        r, want = rows[d["doc_id"]], brute.quality(d["text"])
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["base_failed"] and r["kept"])
        if labels.get(d["doc_id"]) == 0:
            assert not r["kept"]
        if labels.get(d["doc_id"]) == 1 and not want[-1]:
            clean[r["kept"]] += 1
    assert clean[1] and not clean[0]


def test_op4(spark, docs):
    rows = {r["doc_id"]: r for r in got(spark, "op4_pii")}
    for d in docs:
        found, r = brute.base_personal(d["text"]), rows[d["doc_id"]]
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(k == x for x, _, _ in found) for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == brute.sha(brute.joined(found))
        assert r["spans"].startswith(brute.joined(found))


def test_op5(spark):
    import html
    rows = {r["page_id"]: r for r in got(spark, "op5_html_extraction")}
    pages = table(BIG, "pages")
    assert len(rows) == len(pages)
    for p in pages:  # in these pages the article element is the main text
        body = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)
        parts = [] if not body else [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", " ", x).replace(" </b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", body[1])]
        assert rows[p["page_id"]]["text"] == "\n".join(x for x in parts if x)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


def test_op6(spark, docs):
    rows = sorted(tuple(r[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got(spark, "op6_benchmark_decontamination"))
    want = brute.contamination([(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in table(BIG, "benchmark")])
    assert rows == sorted(want) and any(r[-1] for r in rows)


def test_op7(spark, docs):
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got(spark, "op7_minhash_near_dedup"))
    assert rows == sorted(brute.near([(d["doc_id"], d["text"]) for d in docs], 3, 85))


def test_near_duplicates_default(spark, docs):
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.read.parquet(f"{BIG}/documents.parquet")).collect())
    assert rows == sorted(brute.near([(d["doc_id"], d["text"]) for d in docs], 5, 80))


def test_op8(spark, docs):
    rows = got(spark, "op8_language_id")
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_op9(spark, docs):
    rows = got(spark, "op9_sentencepiece")
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)


def test_op10(spark, docs):
    want = brute.repeats([(d["doc_id"], d["text"]) for d in docs], 100)
    rows = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got(spark, "op10_suffix_array_dedup")}
    assert rows == want and any(r[1] for r in want.values())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql(spark, sf, key):
    from tests.oracle_compare import compare, connect
    assert compare(spark, connect(sf), sf, key, QUERIES[key], ORACLE[key]) is None
