"""Only counts of a block's own terms come to the driver, also when the index holds all terms."""

from oncolattice.llm import decontaminate


def test_counts_of_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta w{i} x{i} y{i} gamma " + "delta " * 12) for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "w7 x7 y7 gamma"), ("b", "delta " * 12), ("c", "not there")], "item_id string, text string")
    plain = sorted(r[:5] for r in decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "VOCABULARY", 0)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    seen, kind = [], type(docs)
    whole = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **b: (seen.append(list(whole(self, *a, **b))) if self.columns == ["term", "n"] else None) or iter(seen[-1] if self.columns == ["term", "n"] else whole(self, *a, **b)))
    assert sorted(r[:5] for r in decontaminate.contamination(docs, items).collect()) == plain
    assert [len(x) for x in seen] == [4, 1, 0] and seen[1][0].n == 3600
