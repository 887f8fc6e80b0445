"""Text columns as byte arrays: words, polynomial prefix hashes, and Arrow batch helpers.

A word is a maximal run of word bytes of UTF-8 text, so byte tables stand in for the patterns:
separators are ASCII, and every byte of a non-ASCII character counts as a word byte.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shared_dir

CHUNK = 1 << 20  # bytes worked on at once; a longer document is a chunk of its own
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so powers have inverses modulo 2**64
UNBASE = pow(BASE, -1, 1 << 64)

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
SPACED = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))  # words between white space
ALNUM = (_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122))  # after LOWER

_powers = {BASE: np.ones(1, np.uint64), UNBASE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n, kept and grown by doubling."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; `piece_hash` takes a substring's hash from them."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def piece_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(UNBASE, len(prefix))[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is the empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Start and end byte of each word, and how many words start before each row (n + 1 numbers)."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(piece_hash(prefix_hash(data), starts, ends))


def reduce_rows(how: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """`how` over the values at[i]:at[i + 1] of each row; rows without values get `empty`."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = how.reduceat(values, at[full])
    return out


def number_hash(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def hand_back() -> None:
    """Gives free memory of this Python worker back to the system: it waits for further tasks beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
