"""Periodic runs of words, found as maximal pairs in the tree of LCP intervals.

A maximal pair is two places of equal stretches that neither the word to the left nor the word to the right extends.
A run of period q and length n is a maximal pair of distance q and common length n - q. The tree is walked bottom-up:
every interval keeps its places in order, each with its class, the word to its left; children are merged small into large.
Only partners within half the common length matter, and these lie in one periodic stretch: all partners to the right have the
same class, and of those to the left only the outermost can have another class than the place itself. So two
lookups a place find every primitive pair, whatever the number of classes.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 24      # words of a run
REPEATS = 3     # periods of a run
WORDS = 200_000  # words sorted together; a longer text is sorted alone
_BLOCK = 512

RUN = "struct<start: long, length: long, period: long>"


class _Places:
    """Ordered places in blocks, so that adding one moves a block at most."""

    __slots__ = ("blocks", "tops", "n")

    def __init__(self, place: int):
        self.blocks, self.tops, self.n = [[place]], [place], 1

    def add(self, place: int) -> None:
        k = min(bisect_left(self.tops, place), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, place)
        self.tops[k] = block[-1]
        self.n += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[k:k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.tops[k:k + 1] = [block[_BLOCK - 1], block[-1]]

    def first_from(self, place: int) -> int:
        """Smallest place that is not below the given one, or -1."""
        k = bisect_left(self.tops, place)
        return -1 if k == len(self.tops) else self.blocks[k][bisect_left(self.blocks[k], place)]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def _dense(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Rank of each pair among the distinct ones."""
    key = major.astype(np.int64) * (int(minor.max()) + 1) + minor
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _ranks(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, depth: int | None = None):
    """Ranks of the first 1, 2, 4, ... words of every place, within its text; until all differ, or `depth` words."""
    levels, k = [_dense(owner, ids)], 1
    n = len(ids)
    while (depth is None or k < depth) and int(levels[-1].max()) + 1 < n:
        last = levels[-1]
        after = np.zeros(n, np.int64)
        if k < n:
            after[:-k] = np.where(np.arange(k, n) < ends[:-k], last[k:].astype(np.int64) + 1, 0)
        levels.append(_dense(last, after))
        k *= 2
    return levels


def _common(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words of the places a and b of one text."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y, step = a + out, b + out, 1 << level
        fits = np.maximum(x, y) + step <= ends[a]
        at = np.flatnonzero(fits)
        at = at[levels[level][x[at]] == levels[level][y[at]]]
        out[at] += step
    return out


def _merge(a: _Places, b: _Places, common: int, left: list[int], found: dict, least: int, repeats: int) -> _Places:
    small, large = (a, b) if a.n <= b.n else (b, a)
    reach = common // (repeats - 1)
    for place in small:
        for other in (large.first_from(place + 1), large.first_from(place - reach)):
            gap = abs(place - other)
            if other < 0 or not 0 < gap <= reach or gap + common < least or left[place] == left[other]:
                continue
            key = (min(place, other), gap + common)
            if found.get(key, gap) >= gap:
                found[key] = gap
    for place in small:
        large.add(place)
    return large


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, in order; words are given as numbers, texts by offsets."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(ids):
        return out
    # a pair of distance q needs max(least - q, (repeats - 1) * q) common words, so never less than this
    floor = min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(offsets[1:], sizes)
    depth = 1 << (floor.bit_length() - 1)  # a power of two not above the floor: places alone at this depth are in no pair
    near = _ranks(ids, owner, ends, depth)[-1]
    shared = np.bincount(near)[near] > 1
    some = np.unique(owner[shared])
    if not len(some):
        return out
    inside = np.isin(owner, some)
    ids, owner, shared = ids[inside], owner[inside], shared[inside]
    at = np.concatenate([[0], np.cumsum(sizes[some])])
    ends = np.repeat(at[1:], sizes[some])
    levels = _ranks(ids, owner, ends)
    order = np.argsort(levels[-1], kind="stable")
    order = order[shared[order]]
    common = np.zeros(len(order), np.int64)
    same = np.flatnonzero(owner[order[1:]] == owner[order[:-1]]) + 1
    common[same] = _common(levels, ends, order[same - 1], order[same])
    del levels
    left = np.concatenate([[-1], ids[:-1]])
    left[at[:-1][at[:-1] < len(ids)]] = -1
    left, found = left.tolist(), {}
    stack: list[tuple[_Places, int]] = []
    current = None
    for place, length in zip(order.tolist(), common.tolist()):
        if current is not None:
            if length < floor:
                while stack:
                    below, deep = stack.pop()
                    current = _merge(below, current, deep, left, found, least, repeats)
            else:
                while stack and stack[-1][1] > length:
                    below, deep = stack.pop()
                    current = _merge(below, current, deep, left, found, least, repeats)
                stack.append((current, length))
        current = _Places(place)
    while stack:
        below, deep = stack.pop()
        current = _merge(below, current, deep, left, found, least, repeats)
    for (start, length), period in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        text = owner[start]
        out[text].append((int(start - at[np.searchsorted(some, text)]), length, period))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) > 0


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        words = [w for w, gone in zip(words, dropped(len(words), runs).tolist()) if not gone]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Columns `keep` (default doc_id), n_words, runs, collapsed: periodic runs of the words of every whole text.

    A word is a maximal stretch without ASCII white space. A run has a smallest period q and max(least, repeats * q) words or
    more, and no neighbouring word extends it; `least` is at least 2, `repeats` at least 3. `runs` are ordered by start, then
    period. `collapsed` joins by one space the words that no run holds after its first period. Null, empty and blank
    texts have no words, no runs and an empty collapsed text. Rows are independent: repeated rows, null ids and ties are each
    returned. Columns to keep may have any name but the three added ones. An empty table gives an empty result.
    Texts are sorted together up to some 200,000 words; memory is bounded by that or by the longest text (about 200 bytes a word).
    """
    if least < 2 or repeats < 3:
        raise ValueError("least must be 2 or more, repeats 3 or more")
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep)
    schema = T.StructType([T.StructField("kept", kept.schema, False), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
                           T.StructField("collapsed", T.StringType())])
    run_type = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def solved(texts: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        ids = np.fromiter((number(w, len(numbers)) for text in texts for w in text), np.int64, sum(map(len, texts)))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for text, runs in zip(texts, runs_of(ids, offsets, least, repeats)):
            yield len(text), runs, _collapsed(text, runs).decode()

    def rows(column):
        waiting, n = [], 0
        for value in column:
            text = (value.as_py() or "").encode().split()
            if n and n + len(text) > WORDS:
                yield from solved(waiting)
                waiting, n = [], 0
            waiting.append(text)
            n += len(text)
        if waiting:
            yield from solved(waiting)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, runs, texts = zip(*rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(run_type)),
                pa.array(texts, pa.string())], ["kept", "n_words", "runs", "collapsed"])

    packed = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).cast("string").alias("text"))
    return packed.mapInArrow(run, schema).select("kept.*", "n_words", "runs", "collapsed")


def strongest(runs: str):
    """The run of greatest length per period, compared exactly; ties go to the smallest start, then period. Null if there is none."""
    def better(a, b):
        mine, its = a["length"] * b["period"], b["length"] * a["period"]
        return (mine > its) | ((mine == its) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))))
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | better(x, best), x).otherwise(best))
