"""Near-duplicate removal keeps one row of each group, whatever the ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def text(k):
    return " ".join(f"w{k}x{i}" for i in range(60))


def test_one_row_of_each_group(spark):
    rows = [(None, text(1)), (None, text(1)), (None, text(1) + " end"),      # copies without an id
            (3, text(2)), (3, text(2)), (4, text(2)), (None, text(2)),       # the smallest id stands twice
            (1, text(3)), (5, text(3)), (5, text(4)),                        # an id with a copy and a text of its own
            (None, text(5)), (9, text(5)), (7, None), (7, None), (None, "")]  # nothing to compare
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sum((t or "").startswith(text(1)) for _, t in got) == 1
    rest = [x for x in got if not (x[1] or "").startswith(text(1))]
    assert sorted(rest, key=str) == sorted([(3, text(2)), (1, text(3)), (5, text(4)), (9, text(5)), (7, None), (7, None), (None, "")], key=str)


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.personal_data])
def test_columns_of_the_caller_stay(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("__row", "row0", "ROW1", "component_id", "key", "__doc", "kept", "place")}
    got = stage(spark, docs.withColumns(extra), sf)
    assert got.columns == docs.columns + list(extra)
    rows = got.collect()
    assert len(rows) > 100 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
