"""Removal of repeated long byte strings across a corpus, with hash-compared suffix sorting.

Every window of `length` bytes is governed by its minimizer: the leftmost smallest hash of its `grain`-byte
pieces. Equal windows have equal minimizers at equal offsets, so windows only meet under the same minimizer
hash. A run of windows under one minimizer occurrence is a stretch: it is told apart by a hash of its bytes,
and only stretches that share a minimizer but differ (the edges of repeated passages) need their bytes. Their
suffixes to the right of the minimizer and (mirrored) to its left are sorted by a merge sort whose comparisons
find the common extension by binary search over prefix hashes; classes of equal windows follow from the
common extensions of neighbours, which are checked byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, mix, number_hash, piece_hash, prefix_hash, text_bytes, written

BLOCK = 4096    # stretches sorted together, unless one minimizer has more
STEP = 1 << 18  # bytes of text hashed at once
LAST = 2**63 - 1


def _stretches(data: np.ndarray, at: np.ndarray, length: int, grain: int):
    """Minimizer hash, content hash, row, minimizer position, bytes to its left, and windows of each stretch."""
    n = len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 6
    prefix = prefix_hash(data)
    begin = np.arange(n - grain + 1)
    pieces = mix(piece_hash(prefix, begin, begin + grain) ^ np.uint64(number_hash(grain)))
    # 32 bits of hash over the position: the smallest value is the leftmost smallest hash
    half = np.uint64(32)
    packed = ((pieces >> half) << half) | begin.astype(np.uint64)
    width, have, low = length - grain + 1, 1, packed
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(where)]
    start = np.flatnonzero(np.arange(len(where)) + length <= at[1:][row_of])
    if not len(start):
        return [np.zeros(0, np.int64)] * 6
    where, row = where[start], row_of[start]
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.append(first, len(where)))
    begin, anchor, row = start[first], where[first], row[first]
    content = mix(mix(piece_hash(prefix, begin, begin + count - 1 + length) + (anchor - begin).astype(np.uint64)) + count.astype(np.uint64))
    return pieces[anchor].view(np.int64), content.view(np.int64), row, anchor - at[row], anchor - begin, count


def _marks(docs: DataFrame, length: int, grain: int, told: bool) -> DataFrame:
    """A row per stretch: h, c, doc, t, place (anchor * 2**24 + left * 2**12 + windows), again.

    `again` is set where the same stretch came earlier within the batch; h is then of no further use.
    """
    def run(batches):
        for batch in batches:
            ids, tells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(2))
            parts = []
            for first, last in chunks(offsets, STEP):
                # a long text goes in overlapping pieces; windows stay whole, stretches may be cut
                whole = offsets[last] - offsets[first] <= 4 * STEP or last - first > 1
                step = max(1, offsets[last] - offsets[first]) if whole else STEP
                for begin in range(offsets[first], max(offsets[last], offsets[first] + 1), step):
                    end = offsets[last] if whole else min(begin + step + length - 1, offsets[last])
                    at = offsets[first:last + 1] - begin if whole else np.array([0, end - begin])
                    h, c, row, anchor, left, count = _stretches(data[begin:end], at, length, grain)
                    anchor = anchor + (0 if whole else begin - offsets[first])
                    parts.append((h, c, ids[first + row], tells[first + row], (anchor << 24) | (left << 12) | count))
            columns = [list(x) for x in zip(*parts)] if parts else [[np.zeros(0, np.int64)] for _ in range(5)]
            parts.clear()
            for i, pieces in enumerate(columns):  # one column at a time is held twice
                columns[i] = np.concatenate(pieces)
                pieces.clear()
            order = np.lexsort(columns[::-1])
            for i in range(5):
                columns[i] = columns[i][order]
            h, c, doc, t, place = columns
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            again = same & ((doc != doc[lead]) | (t != t[lead]) | (place != place[lead]))
            # seen within the batch: no need to meet the others, so spread these evenly
            h = np.where(again, mix(place.view(np.uint64) + mix(doc.view(np.uint64))).view(np.int64), h)
            c = np.where(again, np.arange(len(c)), c)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, c, doc, t, place)] + [pa.array(again)],
                                             ["h", "c", "doc", "t", "place", "again"])

    return _keyed(docs, told).mapInArrow(run, "h long, c long, doc long, t long, place long, again boolean")


def _keyed(docs: DataFrame, told: bool) -> DataFrame:
    tell = F.xxhash64("__text") if told else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("__id"), F.lit(LAST)).alias("doc"), tell.alias("t"), F.col("__text").alias("text"))


def _common(prefix: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at i and j, up to `limit`: binary search over hashes."""
    low = np.zeros(len(i), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        there = low + step <= limit
        a, b = i + low, j + low
        to = np.where(there, step, 0)
        same = piece_hash(prefix, a, a + to) == piece_hash(prefix, b, b + to)
        low = np.where(there & same, low + step, low)
        step >>= 1
    return low


def _suffix_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows and the common extension of each with the one before it.

    Bottom-up merge sort: all pairs of runs are merged at once, each suffix finding its rank in the other
    run by binary search. Common extensions of neighbours are checked byte by byte; a hash collision
    (a claimed extension that the bytes refute) falls back to comparing bytes.
    """
    n, size = rows.shape
    flat = np.concatenate([rows.ravel(), np.zeros(1, np.uint8)])
    prefix = prefix_hash(flat)
    at, order, width = np.arange(n) * size, np.arange(n), 1
    while width < n:
        index = np.arange(n)
        run = index // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        begin = low.copy()
        after = run % 2 == 1  # equal suffixes: those of the left run first
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            mine, its = at[order[open_]], at[order[mid]]
            common = _common(prefix, mine, its, size)
            end = common == size
            pos = np.minimum(common, size - 1)
            less = np.where(end, after[open_], flat[its + pos] < flat[mine + pos])  # is the other one before mine?
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        to = (run // 2) * 2 * width + (index - run * width) + (low - begin)
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, width * 2
    sorted_rows = rows[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = _common(prefix, at[order[1:]], at[order[:-1]], size)
        differ = sorted_rows[1:] != sorted_rows[:-1]
        true = np.where(differ.any(1), differ.argmax(1), size)
        if (true != common[1:]).any() or (np.take_along_axis(sorted_rows[1:], np.minimum(true, size - 1)[:, None], 1)
                                          < np.take_along_axis(sorted_rows[:-1], np.minimum(true, size - 1)[:, None], 1)).any():
            order = np.lexsort(rows.T[::-1])
            sorted_rows = rows[order]
            differ = sorted_rows[1:] != sorted_rows[:-1]
            common[1:] = np.where(differ.any(1), differ.argmax(1), size)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Class of each row when rows that agree on their first `depth` bytes are one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(contexts: list[bytes], left: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that came earlier, given stretches in order of occurrence: (stretch, offset of the minimizer in the window)."""
    n, reach = len(contexts), int(left.max(initial=0))
    right_rows, left_rows = np.zeros((n, length), np.uint8), np.zeros((n, reach + 1), np.uint8)
    for i, (text, l) in enumerate(zip(contexts, left.tolist())):
        raw = np.frombuffer(text, np.uint8)
        ahead, back = raw[l:l + length], raw[:l][::-1]
        right_rows[i, :len(ahead)], left_rows[i, :l] = ahead, back
    right, back = _suffix_sort(right_rows), _suffix_sort(left_rows)
    found, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(reach + 1):
        own = np.flatnonzero((o <= left) & (o > left - count))
        if len(own) < 2:
            continue
        key = _classes(*right, length - o)[own] * (n + 1) + _classes(*back, o)[own]
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        later = own[first[group] != np.arange(len(own))]
        found.append(later)
        offsets.append(np.full(len(later), o))
    return np.concatenate(found), np.concatenate(offsets)


def _edges(requests: DataFrame, docs: DataFrame, told: bool, length: int) -> DataFrame:
    """Repeated ranges (doc, t, range) found among stretches that share a minimizer and differ."""
    def solve(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table.column("h").to_numpy()
                change = np.flatnonzero(np.diff(h)) + 1
                if len(change):
                    yield from blocks(table.slice(0, int(change[-1])))
                    table = table.slice(int(change[-1]))
                held, size = table.to_batches(), table.num_rows
        if size:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(table):
        h = table.column("h").to_numpy()
        change = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
        first = 0
        while first < len(h):
            last = int(change[max(np.searchsorted(change, first + BLOCK, "right") - 1, np.searchsorted(change, first, "right"))])
            yield ranges(table.slice(first, last - first))
            first = last

    def ranges(table):
        doc, t, place = (table.column(c).to_numpy() for c in ("doc", "t", "place"))
        order = np.lexsort((place, t, doc))
        doc, t, place = doc[order], t[order], place[order]
        once = np.ones(len(order), bool)  # rows that repeat a document bring its stretches twice
        once[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (place[1:] != place[:-1])
        order, doc, t, place = order[once], doc[once], t[once], place[once]
        texts = table.column("context").to_pylist()
        which, offset = repeated_windows([texts[i] for i in order], (place >> 12) & 4095, place & 4095, length)
        start = (place[which] >> 24) - offset
        return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(t[which]), pa.array((start << 32) | (start + length))], ["doc", "t", "range"])

    begin = F.expr("cast(shiftright(place, 24) - (shiftright(place, 12) & 4095) as int)")
    size = F.expr("cast((place & 4095) - 1 as int)") + length
    contexts = requests.join(_keyed(docs, told), ["doc", "t"]).select(
        "h", "doc", "t", "place", F.col("text").cast("binary").substr(begin + 1, size).alias("context"))
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(solve, "doc long, t long, range long")


def remove_repeats(docs: DataFrame, length: int = 100, grain: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Every document without the bytes of `length`-byte strings that also start earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text` also kept (binary).
    Earlier means in a document of smaller id, or further left in the same one; a null id comes last.
    Strings are judged on the input, overlaps count, and matches never cross documents. Null is the empty
    text. Texts shorter than `length` stay whole. Rows that repeat an id and its text are one document
    and get the same result; rows that share an id with different texts are ordered by a text hash.
    Other columns are ignored; an empty table gives an empty result. Stretches are compared by 64-bit
    hashes of minimizer and content together, windows at their edges by bytes.
    """
    if not 0 < grain <= length < 4000:
        raise ValueError("needs 0 < grain <= length < 4000")
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    told = bool(docs.groupBy(F.coalesce("__id", F.lit(LAST)).alias("i")).count().where("count > 1").take(1))
    same = Window.partitionBy("h", "c").orderBy("doc", "t", "place")
    group = Window.partitionBy("h")
    marks = (_marks(docs, length, grain, told).repartition("h")
             .withColumn("rank", F.rank().over(same))
             .withColumn("mixed", F.min("c").over(group) != F.max("c").over(group))
             .where("again or rank > 1 or mixed")
             .select("h", "doc", "t", "place", (F.col("again") | (F.col("rank") > 1)).alias("again")))
    marks = written(marks)
    # both joins with the texts go by document, so that the texts are shuffled once for the two
    requests = marks.where("not again").select("h", "doc", "t", "place").distinct().hint("merge")
    begin = F.expr("shiftright(place, 24) - (shiftright(place, 12) & 4095)")
    whole = marks.where("again").select("doc", "t", (F.shiftleft(begin, 32) + begin + F.expr("(place & 4095) - 1") + length).alias("range"))
    spans = whole.union(_edges(requests, docs, told, length)).groupBy("doc", "t").agg(F.sort_array(F.collect_set("range")).alias("ranges"))

    def finish(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                if ranges:
                    r = np.array(ranges, np.int64)
                    np.add.at(gone, r >> 32, 1)
                    np.add.at(gone, r & 0xFFFFFFFF, -1)
                gone = np.cumsum(gone[:-1]) > 0
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
                kept = text[~gone].tobytes() if ranges else text.tobytes()
                rows.append((len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, n_spans, digest, kept = zip(*rows) if rows else [()] * 5
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_text, names + ["kept"] * with_text)

    ready = _keyed(docs, told).join(spans, ["doc", "t"], "left").select(F.expr(f"nullif(doc, {LAST})").alias("doc_id"), "text", "ranges")
    return ready.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
