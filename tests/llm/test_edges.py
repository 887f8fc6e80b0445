"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator and stage."""

import base64
import gzip
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oncolattice.llm import components, decontaminate, html, language, neardup, pieces, pii, quality, secrets, suffixes, tokens, vocabulary

from . import brute

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, row int, words string, extra string"
PROSE = "The quick brown fox jumps over the lazy dog while nine wizards boil seven toads near an old mill. " * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, 2, "w", "e") for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "é ß 漢字 𝄞 password=secret99"), (None, PROSE), (7, PROSE), (7, PROSE), (8, PROSE + "end"), (9, "x"), (None, None)]
    return rows, frame(spark, rows).cache()


OPERATORS = {
    "secrets": secrets.secrets, "tokens": tokens.token_counts, "quality": quality.quality, "pii": pii.personal_data,
    "near": neardup.near_duplicates, "pieces": pieces.encode, "repeats": suffixes.remove_repeats,
    "decontaminate": lambda d: decontaminate.contamination(d, d.select("doc_id", "text").withColumn("item_id", F.col("doc_id"))),
    "language": lambda d: language.predict(d, *language.train(d)),
    "html": lambda d: html.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "extra")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(odd, name):
    rows, docs = odd
    assert OPERATORS[name](docs).count() == len(rows)
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(odd, spark, sf, stage):
    rows, docs = odd
    out = stage[1](spark, docs, sf)
    assert stage[0] == "encode" or out.columns == docs.columns
    assert out.count() <= len(rows)
    assert stage[1](spark, docs.limit(0), sf).count() == 0


def test_odd_values(odd):
    rows, docs = odd
    near = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(near, key=str) == sorted([(i, c) for i, _, c in brute.near(rows, 5, 80)], key=str)
    gone = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs.where("doc_id != 4 and doc_id is not null")).collect()}
    assert gone[7] == 0 and gone[8] == len(PROSE)  # repeated rows are one document
    texts = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect() if r.doc_id}
    assert all(texts[i] == (t or "") for i, t in rows if i)
    quiet = {r["__doc"]["doc_id"]: r.kept for r in quality.quality(docs).collect()}
    assert not quiet[1] and not quiet[2] and not quiet[3]


def test_secret_layers():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    inner = f"password = hunter2secret and {key}"
    for wrap in (lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
                 lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
                 lambda t: urllib.parse.quote(base64.b64encode(gzip.compress(base64.b64encode(t.encode()))).decode(), safe=""),
                 lambda t: base64.urlsafe_b64encode(urllib.parse.quote(t, safe="").encode()).decode()):
        packed = wrap(inner)
        base, every = secrets.findings(f"before {packed} after")
        kinds = {(k, 7 <= s < e <= 7 + len(packed)) for s, e, k in every}
        assert {("assign", True), ("access", True)} <= kinds and set(base) <= set(every)
    import bz2
    import lzma
    import zlib
    import zstandard
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress, lambda b: gzip.compress(zlib.compress(b))):
        filler = "line of filler text\n" * 200_000  # several pieces
        packed = base64.b64encode(pack((filler + inner + "\n" + filler).encode())).decode()
        found = secrets.findings(f"x {packed} y")[1]
        assert {(2, 2 + len(packed), "assign"), (2, 2 + len(packed), "access")} <= set(found), pack
    assert secrets.findings("x " + base64.b64encode(gzip.compress(b"\0" * 50_000_000)).decode())[0] == []
    assert secrets.findings(base64.b64encode(gzip.compress((inner + "\n").encode() * 9)[:-12]).decode())[1]
    s, e, _ = next(f for f in secrets.findings("é %41%4B%49%41" + key[4:] + " z")[1])
    assert (s, e) == (2, 2 + 12 + 16)
    assert secrets.findings("token=short token: token=abcdefgh")[0] == [(12, 33, "assign")]
    assert secrets.findings("%2525252525")[1] == [] and secrets.findings("a" * 200_000)[1] != []


def test_base_patterns_like_plain_ones():
    rng = np.random.default_rng(5)
    parts = ["a", "@", ".", "b-", "1", "255", ".", "4111 1111-1111 1111", " ", "+1", "(", ")", "-", "999", "token", "=", ":", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "x_y", "password", "API_KEY", "\n", "ſecret", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert [(k, s, e) for s, e, k in pii.scan(text)] == brute.base_personal(text), text
        assert [(k, s, e) for s, e, k in secrets.findings(text)[0]] == brute.base_secrets(text), text


def test_disclosing_terms(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = [(i, f"{filler} number {i}") for i in range(60)] + [(100 + i, f"the moonbase chief pi can be reached at jo@x.example.com soon pi {i}") for i in range(5)]
    spans = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    text = dict(rows)[100]
    found = {(text[s.start:s.end], s.kind) for s in spans[100]}
    assert ("moonbase", "removed") in found and ("jo@x.example.com", "email") in found and not any(w == "pi" for w, _ in found)
    assert spans[5] == []
    clean = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows)).collect()}
    assert "moonbase" not in clean[100] and "[email]" in clean[100] and clean[5] == dict(rows)[5]


@pytest.mark.parametrize("few", [0, 10**6])
def test_disclosing_terms_far_from_mentions(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "BROADCAST", few)
    filler = "we write this report signed by anyone or ask for contact of it once more and say nothing at all here "
    mail = "contact q@lab.example.org for it "
    rows = [(i, f"{filler}number{i}") for i in range(300)]
    rows += [(1000 + i, f"{mail}{filler * 3}part{i} Signed by Quillfeather") for i in range(6)]
    rows += [(1010, f"{filler}Once more Quillfeather éQuillfeather seen"), (1011, f"{filler}Solo at z@one.example.org by Unmatched")]
    rows += [(1012 + i, f"{i} ask +1 555 0100 777 or Marrowby, {filler}{'x' * i}") for i in (1, 2)]
    rows += [(1020 + i, f"{filler}Copied text of c@copy.example.org by Replica") for i in range(4)] + [(1030, None), (1031, "")]
    docs = frame(spark, rows)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    texts = dict(rows)
    assert clean[1000] == f"contact [email] for it {filler * 3}part0 Signed by [name]"
    assert clean[1010] == f"{filler}Once more [name] éQuillfeather seen"  # the word alone, in a text without the entity
    assert "Marrowby" not in clean[1013] and "Marrowby" not in clean[1014] and clean[1013].endswith(f", {filler}x")
    assert "Unmatched" in clean[1011] and "Replica" in clean[1020]  # no second text speaks for them
    assert clean[5] == texts[5] and clean[1030] is None and clean[1031] == ""
    assert clean[1020] == texts[1020].replace("c@copy.example.org", "[email]")
    spans = {r.doc_id: [(texts[r.doc_id][s.start:s.end], s.kind) for s in r.spans] for r in pii.personal_data(docs).collect() if texts[r.doc_id]}
    assert ("Quillfeather", "general") in spans[1000] and ("Marrowby", "removed") in spans[1013]


def test_clashing_names_of_sanitised(spark):
    docs = frame(spark, [(1, "mail a@b.example.org"), (2, None)]).selectExpr("doc_id", "text", "'A' AS extra0", "1 AS spans", "2 AS key", "3 AS doc", "4 AS hash", "5 AS __text")
    got = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert got[1].text == "mail [email]" and (got[1].extra0, got[1].spans, got[1].key, got[1].doc, got[1].hash, got[1]["__text"]) == ("A", 1, 2, 3, 4, 5)
    assert got[2].text is None and list(got[1].asDict()) == docs.columns


def test_quality_of_long_and_unspaced_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"word{k}" for k in rng.integers(0, 1000, 25000))
    chinese = "\n".join("今天天气很好我们一起去公园散步吧然后回家吃饭" + chr(0x4E00 + k) for k in range(14))
    rows = [(1, long), (2, " ".join(long.split()[:5000])), (3, chinese), (4, "x" * 400 + (" " + "y" * 300 + "z") * 20),
            (5, " ".join(f"a{k % 2}b{k % 3}" + "c" * (k // 300) for k in range(3000))), (6, chinese.replace("\n", " latin words too\n"))]
    docs = frame(spark, rows)
    kept = {r["__doc"]["doc_id"]: (r.kept, r.rejected_by) for r in quality.quality(docs, base="n_words < 10").collect()}
    assert kept[1][0] and kept[2][0] and kept[3][0] and kept[6][0]
    assert not kept[4][0] and not kept[5][0]


def test_proximity(spark):
    items = frame(spark, [(1, "one two three four five six seven eight nine ten")]).select(F.col("doc_id").alias("item_id"), "text")
    docs = frame(spark, [(1, "x one two three four five six seven eight nine ten x"), (2, "ten nine eight seven six five four three two one"), (3, "one two three")])
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (rows[1].n_hit, rows[1].items, rows[1].spans) == (10, ["1"], [(1 << 32) | 11])
    assert (rows[2].n_hit, rows[2].near_items, rows[3].near_items) == (0, ["1"], [])


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(decontaminate.contamination(docs, items).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    assert sorted(decontaminate.contamination(docs, items).collect(), key=lambda r: r.doc_id) == one


@pytest.mark.parametrize("few", [0, 10**6])
def test_joins_beyond_the_broadcast_bounds(spark, sf, monkeypatch, few):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for module in (neardup, suffixes, pii, decontaminate):
        monkeypatch.setattr(module, "VOCABULARY" if module is decontaminate else "BROADCAST", few)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()) == sorted(brute.near(rows, 5, 80))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()} == brute.repeats(rows, 100)
    pii.personal_data(docs).count()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, items).collect())
    assert got == [x[:3] for x in sorted(brute.contamination(rows, [(r.item_id, r.text) for r in items.collect()]))]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in [*range(100, 140), 300]}


def test_chain_inside_a_bucket(spark):
    """Neighbours are linked, ends are not; the smallest member of a bucket need not be linked with all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k:8 * k + 160])) for k in range(20)] + [(50 + k, " ".join(words[:90 - k] + [f"z{k}_{j}" for j in range(10 + k)])) for k in range(12)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted(brute.near(rows, 5, 80))


def test_repeats_with_low_complexity(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ab"), 700)) + "ab" * int(rng.integers(0, 200)) + "a" * int(rng.integers(0, 300)) + "é" * 60) for i in range(12)]
    rows += [(20 + i, rows[i][1][50:400] + rows[i + 1][1][100:330]) for i in range(6)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.repeats(rows, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(spark, rows), length=31, grain=9).collect()}
    assert got == brute.repeats(rows, 31)


def test_repeats_of_a_long_text(spark):
    """Longer than a chunk, so it goes in pieces that cut stretches differently in the two documents."""
    text = np.random.default_rng(7).integers(97, 123, 4_500_000).astype(np.uint8).tobytes().decode()
    rows = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, [(1, text), (2, "first " + text)])).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].n_spans, rows[2].kept_sha256) == (0, len(text), 1, brute.sha("first "))


def test_repeats_broadcast_no_requests(spark):
    """Edges between texts of many-byte characters; the texts are shuffled once for both joins and requests are not broadcast."""
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("aé漢𝄞"), 200))
    rows = [(i, "".join(rng.choice(list("xß字"), 40 + i)) + shared[i:160 + 2 * i] + "".join(rng.choice(list("yö"), 50))) for i in range(8)]
    found = suffixes.remove_repeats(frame(spark, rows))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == brute.repeats(rows, 100)
    plan = found._jdf.queryExecution()
    assert "strategy=broadcast" not in plan.optimizedPlan().toString() and "ReusedExchange" in plan.executedPlan().toString()


def test_suffix_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 24)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, common = suffixes._suffix_sort(rows)
    made = [rows[i].tobytes() for i in order]
    assert made == sorted(made)
    for a, b, n in zip(made, made[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])


def test_encoder_like_the_model():
    import sentencepiece
    model, words = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL), vocabulary.load()
    plain, mixed, other = pieces.Encoder(words, dropout=0), pieces.Encoder(words, 1, 0.3), pieces.Encoder(words, 2, 0.3)
    decoder = pieces.Decoder(words)
    ids = lambda e, t: np.frombuffer(e.text(t), np.int32).tolist()
    for text in (PROSE, "Hello   world\n\tété 漢字 🙂", "  lead and trail  ", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "", "<s> </s> <0x0A>", "Donaudampfschifffahrt unverhältnismäßig"):
        assert ids(plain, text) == model.encode(text)
        assert ids(mixed, text) == ids(pieces.Encoder(words, 1, 0.3), text)
        for e in (plain, mixed, other):
            assert decoder.raw(np.frombuffer(e.text(text), np.int32)).decode() == text
    assert ids(mixed, PROSE) != ids(other, PROSE) != ids(plain, PROSE)
    marked = "a ▁ b▁c"
    assert decoder.raw(np.frombuffer(mixed.text(marked), np.int32)).decode() == marked


def test_counter_ties():
    words = vocabulary.Vocabulary({"▁": (1, -1.0), "a": (2, -1.0), "aa": (3, -2.0), "▁a": (4, -2.0), "b": (5, -3.0)}, [b""] * 6, 100)
    counter = tokens.Counter(words)
    # of equal scores the earliest start of the last piece holds: [▁a][aa] over [▁][a][aa], [▁a][a][a], ...
    assert counter.text("aaa") == (2, -4.0)
    assert counter.text("c")[0] == 2 and counter.text("é")[0] == 3 and counter.text(None) == (0, 0.0)


def test_mixture(spark):
    texts = {"en": "the house and the garden were with them that this when there", "de": "das haus und der garten waren mit ihnen dass dieses wenn nicht", "fr": "la maison et le jardin etaient avec eux que cette quand pas"}
    docs = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    langs, logs = language.train(docs)
    both = spark.createDataFrame([(1, (texts["en"] + " " + texts["de"]) * 8), (2, texts["fr"] * 8), (3, "1234 !!"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.predict(both, langs, logs).collect()}
    assert sorted(rows[1].langs) == ["de", "en"] and abs(rows[1].proportions[0] - 0.5) < 0.1
    assert rows[2].langs == ["fr"] and rows[3].lang_pred == rows[4].lang_pred == "und"


def test_page_parts():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Menu one</a></nav><div class="cookie-notice">We use cookies, yes.</div>
    <main><article><h2>Head &amp; line</h2><p>First <b>bold</b> text, with   spaces.<p>Second one; it goes on, and on.<ul><li>Item a.<li>Item b.</ul></article></main>
    <aside>Side.</aside><form>Mail <input></form><section id="comments"><p>Reader says, hello.</p></section><footer>Foot.</footer><script>var a = "<p>x</p>";</script></body></html>"""
    assert html.main_text(page) == "Head & line\nFirst bold text, with spaces.\nSecond one; it goes on, and on.\nItem a.\nItem b."
    assert html.main_text("plain text only") == "plain text only" and html.main_text("<p unfinished") == ""


def test_rule_order(spark):
    docs = frame(spark, [(i, PROSE) for i in range(30)] + [(100 + i, "a b # " * 40) for i in range(20)])
    sample = quality.features(docs).drop("__doc")
    order = quality.cascade_order(sample, {"never": "n_words < 0", "symbols": "10 * n_symbols > n_words"})
    assert order == ["symbols", "never"]
    judged = quality.quality(docs, {"symbols": "10 * n_symbols > n_words"}, base="false")
    assert {r.rejected_by: r["count"] for r in judged.groupBy("rejected_by").count().collect()} == {None: 30, "symbols": 20}
