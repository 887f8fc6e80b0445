"""Product codes of vectors: a codebook per part, learned by integer rounds, with equal-average nearest-entry search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24   # scaled components are held to this size, so that all sums are exact in 64 bits
_CELLS = 1 << 20  # components worked on at once


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower index) and its squared distance, for each row of integers.

    Entries stand in order of their component sums. Search goes outward from the row's own sum; by Cauchy's inequality an entry whose
    squared sum gap over the dimension strictly exceeds the best distance cannot be as near, nor can any beyond it.
    """
    n, width = x.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, total = sums[order], x.sum(axis=1)
    up = np.searchsorted(sums, total)
    down = up - 1
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    far = np.int64(1) << 31  # beyond any gap
    rows = np.arange(n)
    while len(rows):
        low, high = down[rows], up[rows]
        gap_low = np.where(low >= 0, total[rows] - sums[np.maximum(low, 0)], far)
        gap_high = np.where(high < len(sums), sums[np.minimum(high, len(sums) - 1)] - total[rows], far)
        gap = np.minimum(gap_low, gap_high)
        on = (gap < far) & (gap * gap <= _times(best[rows], width))
        rows, below = rows[on], (gap_low <= gap_high)[on]
        entry = order[np.where(below, low[on], high[on])]
        down[rows[below]] -= 1
        up[rows[~below]] += 1
        apart = x[rows] - book[entry]
        apart = (apart * apart).sum(axis=1)
        better = (apart < best[rows]) | ((apart == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = apart[better], entry[better]
    return index, best


def _times(best: np.ndarray, width: int) -> np.ndarray:
    top = np.iinfo(np.int64).max
    return np.where(best > top // max(1, width), top, best * width)


def kept_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there, not empty, and has finite components only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)


def _scaled(column: pa.Array, width: int, scale: int) -> np.ndarray:
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return np.clip(flat, -LIMIT, LIMIT).astype(np.int64).reshape(-1, width)


def _blocks(batch: pa.RecordBatch, width: int):
    step = max(1, _CELLS // width)
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def learn(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks as integers of shape (parts, entries, width of a part), from all kept vectors.

    They start as the parts of the vectors with the `entries` smallest ids (ties by the components). A round assigns every part of every vector to
    its nearest entry and replaces each entry by the floored mean of its parts; an unused entry stays. Tasks send one row of
    sums per used entry, whatever their number of vectors. Fewer vectors give fewer entries; none give shape (parts, 0, 0).
    """
    kept = kept_vectors(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0])
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    first = np.array([v for v in first if len(v) == width])
    books = np.clip(np.floor(first * scale), -LIMIT, LIMIT).astype(np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    like = kept.where(F.size("v") == width).select("v")
    for _ in range(rounds):
        got = like.mapInArrow(_sums(books, scale), "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]).collect()
        books = books.copy()
        for part, entry, n, *sums in got:
            books[part, entry] = [x // n for x in sums]
    return books


def _sums(books: np.ndarray, scale: int):
    parts, entries, wide = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            for block in _blocks(batch, parts * wide):
                x = _scaled(block.column(0), parts * wide, scale).reshape(-1, parts, wide)
                for part in range(parts):
                    index, _ = nearest(x[:, part], books[part])
                    counts[part] += np.bincount(index, minlength=entries)
                    np.add.at(sums[part], index, x[:, part])
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                                              pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def encode(rows: DataFrame, books: np.ndarray, keep: list[str] | None = None, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Columns `keep` (default vec_id), entries (index of the nearest entry per part), error (squared distances summed over parts).

    Rows whose vector is null, empty, or holds a null or non-finite component have no code and are left out, as are vectors of another length
    than those the codebooks were learned from. Scaled components are held to +-2^24 (a component of 65,536 at the
    default scale), so that every sum is exact. Repeated rows, null ids and null labels are each returned; columns to keep may have any
    name but the two added ones. An empty table gives an empty result.
    """
    keep = ["vec_id"] if keep is None else keep
    parts, entries, wide = books.shape
    kept = kept_vectors(rows.select(F.struct(*keep).alias("kept"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    kept = kept.where(F.size("v") == parts * wide)
    schema = T.StructType([kept.schema["kept"], T.StructField("entries", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            for block in _blocks(batch, parts * wide):
                x = _scaled(block.column(1), parts * wide, scale).reshape(-1, parts, wide)
                index, error = np.empty((len(x), parts), np.int32), np.zeros(len(x), np.int64)
                for part in range(parts):
                    index[:, part], best = nearest(x[:, part], books[part])
                    error += best
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(index.ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), lists, pa.array(error)], ["kept", "entries", "error"])

    return kept.mapInArrow(run, schema).select("kept.*", "entries", "error")


def with_group_error(coded: DataFrame, group_col: str) -> DataFrame:
    """Adds label_error: the errors of all rows of equal `group_col` summed, nulls together. `coded` is read twice.

    Errors are summed within tasks before they meet, and the sums are joined back, so a group of any size is never one task.
    """
    sums = written(coded.groupBy(F.col(group_col).alias("__group")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, coded[group_col].eqNullSafe(sums["__group"])).drop("__group")
