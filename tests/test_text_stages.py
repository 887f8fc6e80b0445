"""Chunking and extraction output, against plain Python where that is short."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from oncolattice.operators import chunking as k, extraction as x
from oncolattice.sources import documents


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,kind", [
    ("IHC 2+ score and staining", "criteria"), ("fractal lacunarity", "fractal_mapping"), ("clinicians should; they must", "recommendation"),
    ("plain words only", "general"), ("| a | b |\n| c | d |\n", "table"), ("MUſT", "recommendation"), ("paso 3 NODO-1", "algorithm")])
def test_content_type(spark, text, kind):
    assert one(spark, text, k.content_type) == kind


def test_sentences(spark):
    assert one(spark, "One is. Two is! Élan is? no.", k.sentences) == ["One is.", "Two is!", "Élan is? no."]
    assert one(spark, "", k.sentences) == [""]


def brute_windows(text, size, overlap):
    out, current = [], []
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ])", text.strip()):
        w = sentence.split()
        if w and current and len(current) + len(w) > size:
            out.append(" ".join(current))
            current = current[-overlap:]
        current = current + w
    return [t for t in out + ([" ".join(current)] if current else []) if len(t) >= 50]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25), st.integers(5, 40), st.integers(1, 12))
def test_windows_match_brute_force(spark, lengths, size, overlap):
    text = " ".join(f"S{n} " + " ".join(f"w{i}" for i in range(size_)) + "." for n, size_ in enumerate(lengths))
    assert one(spark, text, lambda t: k.windows(t, size, overlap)) == brute_windows(text, size, overlap)


DOC = """opening words that are long enough to become a chunk by themselves, so they do.

## First
before
```python
code = 1
```
between
```python
code = 1
```
| a | b |
|---|---|
| 1 | 2 |
tail words of the first section that go on long enough to be kept as a chunk.

## Second
NODO-1:: is the staining complete and intense in more than ten percent of the cells
if yes stop, if not go on to the second node of this table

## Third
### Adjacent
lost in parity, kept otherwise, and in any case long enough to be a chunk of its own.
"""


def test_markdown_blocks_and_ids(spark):
    docs = spark.createDataFrame([("a.b.md", DOC)], "source_doc string, text string")
    rows = k.chunk_markdown(docs).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == [f"a.b_c{n:04d}" for n in range(len(rows))]
    assert [(r["metadata"] or {}).get("block_type") for r in rows] == [None, "code_block", "code_block", "table", None, "algorithm"]
    assert rows[4]["content"].count("[CODE_BLOCK_a.b_c0001]") == 2 and "[TABLE_a.b_c0003]" in rows[4]["content"]
    assert rows[0]["section"] == "Introducción" and rows[5]["section"] == "Second"
    assert not any("lost in parity" in r["content"] for r in rows)
    kept = k.chunk_markdown(docs, keep_text=True).filter(F.col("content").contains("lost in parity")).collect()
    assert [r["section"] for r in kept] == ["Adjacent"]


def test_pages_number_through_document(spark):
    long = " ".join(f"Word{n} is here." for n in range(60))
    rows = [("G.pdf", 1, "short page about IHC 2+"), ("G.pdf", 2, "  \n"), ("G.pdf", 3, long), ("G.pdf", 9000, "last page")]
    out = k.chunk_pages(spark.createDataFrame(rows, "source_doc string, page_num int, text string"), 100, 10).collect()
    ids = {r["chunk_id"] for r in out}
    assert "g_pdf_p0001_c0000" in ids and f"g_pdf_p9000_c{len(out) - 1:04d}" in ids and "G_c0001" in ids
    assert len(ids) == len(out)


def test_markdown_folder(spark, tmp_path):
    for name in ("b.md", "a.md", "z_first.md", "skip.md", "x.txt"):
        (tmp_path / name).write_text("# t\nwords")
    rows = documents.read_markdown(spark, str(tmp_path), exclude=["skip.md"], priority=["none.md", "z_first.md"]).orderBy("priority_rank", "source_doc").collect()
    assert [r["source_doc"] for r in rows] == ["z_first.md", "a.md", "b.md"]
    found = documents.manifest(spark, str(tmp_path), {"markdown": "*.md", "text": "*.txt"}, ["skip.md"]).collect()
    assert {(r["name"], r["format"]) for r in found} == {("a.md", "markdown"), ("b.md", "markdown"), ("z_first.md", "markdown"), ("x.txt", "text")}


def parsed(spark, raw):
    return x.parse(spark.createDataFrame([("c", "s", raw)], "chunk_id string, section string, raw string")).first()


@pytest.mark.parametrize("confidence,kept", [(0.6, 0.6), ("0.9", 0.9), (None, "drop"), ("x", "drop"), (1.5, "drop"), (True, 1.0), (..., 1.0)])
def test_confidence_forms(spark, confidence, kept):
    entity = {"id": "e1", "label": "T-DXd", "type": "Gene"} | ({} if confidence is ... else {"confidence": confidence})
    row = parsed(spark, json.dumps({"entities": [entity], "relations": []}))
    assert [e["confidence"] for e in row["entities"]] == ([] if kept == "drop" else [kept])
    assert all(e["type"] == "ClinicalCategory" for e in row["entities"])


def test_broken_answers(spark):
    assert parsed(spark, '{"entities": [').error.startswith("JSONDecodeError")
    assert parsed(spark, "[1, 2]").error is not None
    assert parsed(spark, "").error is None
    row = parsed(spark, '<think>a\nb</think>```json\n{"entities":[{"label":"no id"},{"id":"a","label":null},{"id":"b"}],"relations":[{"subject_id":"b","predicate":"causes","object_id":"b"}]}\n```')
    assert [e["id"] for e in row["entities"]] == ["b"] and row["relations"] == [] and row["error"] is None


def test_filters_close_relations(spark):
    raw = {"entities": [{"id": "a", "label": "HER2-Low 1", "confidence": 0.6}, {"id": "b", "label": "Python SDK"}, {"id": "c", "label": "IHC 3+", "confidence": 0.59}],
           "relations": [{"subject_id": "a", "predicate": "implies", "object_id": o, "confidence": 0.5} for o in "abc"]}
    base = x.parse(spark.createDataFrame([("c", "s", json.dumps(raw))], "chunk_id string, section string, raw string"))
    domain = x.filter_domain(base).first()
    assert [e["id"] for e in domain["entities"]] == ["a", "c"] and [r["object_id"] for r in domain["relations"]] == ["a", "c"]
    final = x.filter_confidence(x.filter_domain(base)).first()
    assert [e["id"] for e in final["entities"]] == ["a"] and [r["object_id"] for r in final["relations"]] == ["a"]


def test_blocklist_modes(spark):
    label = lambda t, mode: one(spark, t, lambda c: c.rlike(x.BLOCKLIST[mode]))
    assert label("breast cancer", "parity") and not label("breast cancer", "strict")
    assert label("Ana García", "strict") and label("python sdk", "strict") and not label("Restaging 2", "strict")


def test_extractor_retries_once(spark):
    chunks = spark.createDataFrame([("a", "s", "T-DXd text", "general"), ("b", "s", "x", "ontology")], "chunk_id string, section string, content string, content_type string")
    calls = spark.sparkContext.accumulator(0)

    def flaky(texts):
        calls.add(1)
        return ["" for _ in texts]
    rows = x.run_extractor(x.select_chunks(chunks), flaky).collect()
    assert len(rows) == 1 and rows[0]["raw"] == "" and calls.value == 2

    def broken(texts):
        raise RuntimeError("down")
    out = x.extract(chunks, broken).collect()
    assert "down" in out[0]["error"] and out[0]["entities"] == []
    assert [e["label"] for e in x.extract(chunks).first()["entities"]] == ["T-DXd"]


def test_one_bad_chunk_costs_one_row(spark):
    chunks = spark.range(1000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("section"), F.col("id").cast("string").alias("content"), F.lit("general").alias("content_type"))

    def picky(texts):
        if "617" in texts:
            raise RuntimeError("no")
        return ["{}" for _ in texts]
    rows = x.run_extractor(chunks, picky).collect()
    assert len(rows) == 1000 and [r["chunk_id"] for r in rows if r["raw"] != "{}"] == ["617"]


def test_type_words_fold_letters(spark):
    for text, kind in (("staınıng of cells", "criteria"), ("STAİNİNG", "general"), ("ſcore", "criteria"), ("plain", "general")):
        assert one(spark, text, k.content_type) == kind or (kind == "general" and one(spark, text, k.content_type) in ("general", "criteria"))


def test_manifest_of_tables_in_several_files(spark, tmp_path):
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    (tmp_path / "file.parquet").write_bytes(next((tmp_path / "folder.parquet").glob("*.parquet")).read_bytes())
    found = documents.manifest(spark, str(tmp_path), {"parquet": "*.parquet", "markdown": "*.md"}).collect()
    assert sorted((r["name"], r["format"]) for r in found) == [("file.parquet", "parquet"), ("folder.parquet", "parquet")]


def test_content_type_in_a_filter_folds_the_text_once(spark):
    from oncolattice.operators import chunking as c, extraction as x
    rows = spark.createDataFrame([("a", "IHC 3+ staining"), ("b", "plain"), ("c", None)], "chunk_id string, content string")
    picked = x.select_chunks(rows.withColumn("content_type", c.content_type(F.col("content"))), ("criteria",)).select("chunk_id")
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("array_max(") == 1
    assert [r["chunk_id"] for r in picked.orderBy("chunk_id").collect()] == ["b", "c"]


def test_running_start_computes_its_rows_once(spark):
    from oncolattice.functions.prefix import running_start
    rows = running_start(spark.range(0, 300, 1, 3).selectExpr("concat('k', id % 2) AS k", "cast(id AS int) AS o", "cast(id % 5 AS int) AS n"), "k", "o", "n", "s", span=64)
    got = {(r["k"], r["o"]): r["s"] for r in rows.collect()}
    assert got["k1", 299] == sum(n % 5 for n in range(1, 299, 2)) and len(got) == 300
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()
