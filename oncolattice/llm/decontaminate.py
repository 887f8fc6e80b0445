"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: a row is a segment of some hundred documents with the posting
lists (document, position) of its terms. Hot terms are so split over segments, and nothing is shuffled.
A phrase is looked up by its rarest term first (rarest over the whole corpus), and the candidates are
intersected with the offset-adjusted lists of its other terms, rarest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, chunks, text_bytes, word_hashes, words, written

SEGMENT = 1 << 20      # bytes of text in a segment
ITEM_BYTES = 4 << 20   # text of benchmark items looked up in one pass; more items go in further passes
VOCABULARY = 4_000_000  # so many test terms (8 bytes each) may be sent out to thin the index; with more it holds all terms
CANDIDATES = 200_000   # places of windows that are looked at together
SCHEMA = "segment long, segment_docs array<long>, n_words array<int>, terms array<long>, sizes array<int>, docs binary, positions binary"


def _hashed(column: pa.Array):
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets, SEGMENT):
        at = offsets[first:last + 1] - offsets[first]
        low = LOWER[data[offsets[first]:offsets[last]]]
        starts, ends, row = words(low, at, ALNUM)
        yield first, last, word_hashes(low, starts, ends), row


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the index. `vocabulary` (sorted word hashes) keeps the postings of these terms only."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches):
        from pyspark import TaskContext
        segment = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, hashed, row in _hashed(batch.column(1)):
                doc = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(row))
                pos = (np.arange(len(hashed)) - row[:-1][doc]).astype(np.int32)
                if known is not None and len(known.value):
                    at = np.minimum(np.searchsorted(known.value, hashed), len(known.value) - 1)
                    kept = np.flatnonzero(known.value[at] == hashed)
                    rank, doc, pos = at[kept], doc[kept], pos[kept]
                    order = np.argsort(rank.astype(np.int32), kind="stable")  # radix: doc, pos stay in order
                    term = known.value[rank[order]]
                elif known is not None:
                    order, term = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                else:
                    order = np.argsort(hashed, kind="stable")
                    term = hashed[order]
                cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                segment += 1
                yield pa.RecordBatch.from_pylist([{
                    "segment": segment, "segment_docs": ids[first:last], "n_words": np.diff(row).tolist(),
                    "terms": term[cut].view(np.int64).tolist(), "sizes": np.diff(np.append(cut, len(term))).tolist(),
                    "docs": doc[order].tobytes(), "positions": pos[order].tobytes()}],
                    pa.schema([("segment", pa.int64()), ("segment_docs", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())),
                               ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("positions", pa.binary())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _windows(texts: list, width: int):
    """Of every item's windows: item number, word hashes padded to `width`, length."""
    item, rows, length = [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int64)]
    for first, last, hashed, row in _hashed(pa.array(texts, pa.string())):
        for i in range(last - first):
            own = hashed[row[i]:row[i + 1]]
            if len(own) >= width:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, width))
            elif len(own):
                rows.append(np.pad(own, (0, width - len(own)))[None])
            else:
                continue
            item.append(np.full(len(rows[-1]), first + i))
            length.append(np.full(len(rows[-1]), min(width, len(own))))
    return np.concatenate(item), np.concatenate(rows), np.concatenate(length)


class _Segment:
    """Postings of one segment as one sorted array of (term, document, position) numbers."""

    def __init__(self, terms, sizes, docs, positions):
        self.terms = terms
        self.sizes = sizes.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.docs, self.positions = docs.astype(np.int64), positions.astype(np.int64)
        self.span = int(self.positions.max(initial=0)) + 2
        self.n_docs = int(self.docs.max(initial=0)) + 1
        rank = np.repeat(np.arange(len(terms)), np.diff(self.starts))
        self.keys = (rank * self.n_docs + self.docs) * self.span + self.positions

    def ranks(self, hashes):
        """Row of each term here, -1 where the segment has none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def postings(self, ranks):
        """Postings of several terms: which of them, document, position."""
        n = self.starts[ranks + 1] - self.starts[ranks]
        which = np.repeat(np.arange(len(ranks)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.starts[ranks][which]
        return which, self.docs[at], self.positions[at]

    def near(self, rank, doc, low, high):
        """Does the term occur in the document at a position from low to high?"""
        base = (rank * self.n_docs + doc) * self.span
        at = np.searchsorted(self.keys, base + np.clip(low, 0, self.span - 1))
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= (base + np.clip(high, -1, self.span - 1))[found]
        return found & (rank >= 0) & (high >= 0) & (low < self.span)


def _ranges(on: np.ndarray) -> list:
    """Runs of true values as start * 2**32 + end."""
    if not on.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]]).astype(np.int8)))
    return ((edge[::2] << 32) | edge[1::2]).tolist()


def _counts(index: DataFrame, used: np.ndarray) -> DataFrame:
    """How often each of the `used` terms (sorted) occurs in all documents; terms that occur nowhere have no row."""
    shared = index.sparkSession.sparkContext.broadcast(used)

    def run(batches):
        known = shared.value
        for batch in batches:
            terms, sizes = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            at = np.minimum(np.searchsorted(known, terms.view(np.uint64)), len(known) - 1)
            same = known[at] == terms.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(terms[same]), pa.array(sizes[same].astype(np.int64))], ["term", "n"])

    return index.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _lookup(index: DataFrame, items: list, width: int, slop: int) -> DataFrame:
    """Hits of one block of items: doc row of the segment with hit ranges and items."""
    session = index.sparkSession
    item, grams, length = _windows([t for _, t in items], width)
    names = [i for i, _ in items]
    used = np.unique(grams[np.arange(width) < length[:, None]]) if len(grams) else np.zeros(0, np.uint64)
    have = {np.int64(r.term).astype(np.uint64).item(): r.n for r in _counts(index, used).toLocalIterator()} if len(used) else {}
    frequency = np.array([have.get(t, 0) for t in used.tolist()], np.int64)
    rank = np.searchsorted(used, grams) if len(used) else grams.astype(np.int64)
    weight = np.where(np.arange(width) < length[:, None], frequency[np.minimum(rank, max(len(used) - 1, 0))] if len(used) else 0, np.iinfo(np.int64).max)
    order = np.argsort(weight, axis=1, kind="stable")  # rarest first; padding last
    alive = np.take_along_axis(weight, order[:, :1], 1)[:, 0] > 0 if len(grams) else np.zeros(0, bool)
    shared = session.sparkContext.broadcast((item[alive], grams[alive], length[alive], order[alive]))

    def run(batches):
        item, grams, length, order = shared.value
        reach = width + slop
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_words, terms, sizes = (batch.column(c)[row].values for c in range(1, 5))
                segment = _Segment(terms.to_numpy().view(np.uint64), sizes.to_numpy(), *(np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in (5, 6)))
                line = np.arange(len(item))
                first = segment.ranks(grams[line, order[:, 0]]) if len(item) else line
                here = np.flatnonzero(first >= 0)
                n = n_words.to_numpy()
                base = np.concatenate([[0], np.cumsum(n)])
                cover = np.zeros(base[-1] + 1, np.int32)
                hits, closes = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
                before = np.concatenate([[0], np.cumsum(segment.sizes[first[here]])])
                begin = 0
                while begin < len(here):  # so many candidates at once
                    end = max(begin + 1, int(np.searchsorted(before, before[begin] + CANDIDATES, "right")) - 1)
                    own = here[begin:end]
                    begin = end
                    which, doc, pos = segment.postings(first[own])
                    window = own[which]
                    start = pos - order[window, 0]
                    exact, together = start >= 0, np.ones(len(window), bool)
                    for j in range(1, width):
                        rest = np.flatnonzero((j < length[window]) & (exact | together))
                        offset = order[window[rest], j]
                        other = segment.ranks(grams[window[rest], offset])
                        goal = start[rest] + offset
                        exact[rest] &= segment.near(other, doc[rest], goal, goal) & (goal >= 0)
                        together[rest] &= segment.near(other, doc[rest], np.maximum(pos[rest] - reach, 0), pos[rest] + reach)
                    at = base[doc[exact]] + start[exact]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length[window[exact]], -1)
                    hits.append(np.unique(np.stack([doc[exact], item[window[exact]]], 1), axis=0))
                    closes.append(np.unique(np.stack([doc[together], item[window[together]]], 1), axis=0))
                on = np.cumsum(cover[:-1]) > 0
                hit = np.concatenate([[0], np.cumsum(on)])
                named = [[] for _ in n]
                for d, i in np.concatenate(hits).tolist():
                    named[d] += [names[i]] if names[i] is not None else []
                close = [[] for _ in n]
                for d, i in np.concatenate(closes).tolist():
                    close[d] += [names[i]] if names[i] is not None else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * len(n), pa.int64()), pa.array(np.arange(len(n))), ids.cast(pa.int64()), n_words.cast(pa.int64()), pa.array(hit[base[1:]] - hit[base[:-1]], pa.int64()),
                     pa.array([sorted(set(x)) for x in named], pa.list_(pa.string())), pa.array([sorted(set(x)) for x in close], pa.list_(pa.string())),
                     pa.array([_ranges(on[a:b]) for a, b in zip(base[:-1], base[1:])], pa.list_(pa.int64()))],
                    ["segment", "row", "doc_id", "n_words", "n_hit", "items", "near_items", "spans"])

    return index.mapInArrow(run, "segment long, row long, doc_id long, n_words long, n_hit long, items array<string>, near_items array<string>, spans array<long>")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items (id, text) in blocks of bounded size, read partition by partition."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        block.append(tuple(row))
        size += len(row[1].encode())
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark items found in every document: doc_id, n_words, n_hit, items, near_items, spans.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters. A window is
    `width` consecutive words of an item, or a shorter item as a whole. n_hit counts the document's words
    inside an occurrence of any window and spans holds their ranges (start * 2**32 + end, in words). items
    lists the ids, as sorted strings, of items with an occurring window; near_items those with a window all
    of whose words lie within `width + slop` words of its rarest word, in any order.

    Null and empty texts have no words; items without words never occur; repeated items and rows count as
    given (equal item ids are listed once, a null item id is left out of the lists). Other columns are
    ignored. Words are compared by 64-bit hashes. Results per document row, whatever its id.
    """
    vocabulary = np.zeros(0, np.uint64)
    for block in _blocks(benchmark, item_col, item_text_col):
        for *_, hashed, _ in _hashed(pa.array([t for _, t in block], pa.string())):
            vocabulary = np.union1d(vocabulary, hashed) if vocabulary is not None else None
        if vocabulary is not None and len(vocabulary) > VOCABULARY:
            vocabulary = None
            break
    index = written(build_index(docs, vocabulary, id_col, text_col))
    found = [_lookup(index, block, width, slop) for block in _blocks(benchmark, item_col, item_text_col)] or [_lookup(index, [], width, slop)]
    if len(found) == 1:
        return found[0].drop("segment", "row")
    every = written(found[0])
    for more in found[1:]:
        every = every.union(written(more))
    flat = lambda c: F.flatten(F.collect_list(c))
    merged = every.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("items").alias("items"),
                                                 flat("near_items").alias("near_items"), F.sort_array(flat("spans")).alias("spans"))
    total = """aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct(
        'n', a.n + greatest(0L, (s & 4294967295L) - greatest(shiftright(s, 32), a.to)), 'to', greatest(a.to, s & 4294967295L)), a -> a.n)"""
    return merged.select("doc_id", "n_words", F.expr(total).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"),
                         F.array_sort(F.array_distinct("near_items")).alias("near_items"), "spans")
