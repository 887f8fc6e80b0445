"""Language identification as a mixture: how much of a document is in each language.

Per language, byte trigrams of the training texts are counted. A document's words are draws from a mixture
of the languages; expectation-maximisation estimates its proportions, and the set of languages with the
best penalised likelihood is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, reduce_rows, text_bytes, written

BUCKETS = 1 << 16
PENALTY = 3.0   # log-likelihood that each further language must gain, in units of log(words)
ROUNDS = 8
MODEL_ROWS = 4_000_000  # largest model that is sent out; with more (language, bucket) counts an error is raised

_b = np.arange(256)
SYMBOL = np.where(((_b >= 97) & (_b <= 122)) | (_b >= 128), _b, 32).astype(np.uint32)


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram ending at each byte (0 between words), and whether the byte is in a word."""
    symbol = SYMBOL[LOWER[data]]
    one = np.concatenate([[32], symbol[:-1]]).astype(np.uint32)[:len(symbol)]
    two = np.concatenate([[32, 32], symbol[:-2]]).astype(np.uint32)[:len(symbol)]
    edge = at[:-1][at[:-1] < len(symbol)]
    one[edge], two[edge] = 32, 32
    two[edge[edge + 1 < len(symbol)] + 1] = 32
    two[one == 32] = 32
    h = (symbol * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA77)) ^ (two * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64), symbol != 32


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log probability of each bucket, from all rows with text and language."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_bytes(batch.column(1))
            for first, last in chunks(offsets):
                at = offsets[first:last + 1] - offsets[first]
                bucket, inside = _grams(data[offsets[first]:offsets[last]], at)
                distinct, number = np.unique(names[first:last].astype(str), return_inverse=True)
                row = np.repeat(number, np.diff(at))[inside]
                made = np.bincount(row * BUCKETS + bucket[inside], minlength=len(distinct) * BUCKETS).reshape(-1, BUCKETS)
                for name, own in zip(distinct.tolist(), made):
                    counts[name] = counts.get(name, 0) + own
        for name, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "bucket", "n"])

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    table = written(known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    size = table.count()
    if size > MODEL_ROWS:
        raise ValueError(f"{size} counts are more than a model may have")
    rows = table.toPandas()
    langs = sorted(set(rows["lang"]))
    counts = np.full((len(langs), BUCKETS), 0.5)
    if langs:
        counts[np.searchsorted(langs, rows["lang"]), rows["bucket"]] += rows["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _mixtures(likelihood: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions per document from the log-likelihoods of its words (words x languages)."""
    n_docs, n_langs = len(at) - 1, likelihood.shape[1]
    n_words = np.diff(at)
    doc = np.repeat(np.arange(n_docs), n_words)
    top = likelihood.max(1, initial=-np.inf)
    odds = np.exp(likelihood - top[:, None])

    def fit(share, rounds):
        for _ in range(rounds):
            part = odds * share[doc]
            part /= np.maximum(part.sum(1), 1e-30)[:, None]
            share = np.stack([reduce_rows(np.add, part[:, k], at, 0) for k in range(n_langs)], 1) / np.maximum(n_words, 1)[:, None]
        return share

    def value(share):
        return reduce_rows(np.add, np.log(np.maximum((odds * share[doc]).sum(1), 1e-30)), at, 0)

    full = fit(np.full((n_docs, n_langs), 1 / n_langs, np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_value = None, None
    for size in range(1, n_langs + 1):
        allowed = np.zeros_like(full, bool)
        np.put_along_axis(allowed, order[:, :size], True, 1)
        share = np.where(allowed, np.maximum(full, 1e-3), 0).astype(np.float32)
        share = fit(share / share.sum(1, keepdims=True), 0 if size == 1 else ROUNDS // 2)
        worth = value(share) - penalty * (size - 1) * np.log(np.maximum(n_words, 2))
        if best is None:
            best, best_value = share, worth
        else:
            better = worth > best_value
            best, best_value = np.where(better[:, None], share, best), np.where(better, worth, best_value)
    return best


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion), langs and proportions of the kept set, largest first.

    The whole text counts. Null, and a text without letters, is `und` with score 0 and no languages, and so
    is everything if no language was learned. Each row stands for itself; only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def run(batches):
        langs, logs = shared.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            texts = batch.column(1)
            parts = []
            for first, last in chunks(offsets):
                at = offsets[first:last + 1] - offsets[first]
                bucket, inside = _grams(data[offsets[first]:offsets[last]], at)
                begin = inside.copy()
                begin[1:] &= ~inside[:-1]
                edge = at[:-1][at[:-1] < len(inside)]
                begin[edge] = inside[edge]
                starts = np.flatnonzero(begin)
                word_at = np.append(starts, len(inside))
                row_at = np.searchsorted(starts, at)
                if not langs:
                    parts.append(np.zeros((last - first, 0), np.float32))
                    continue
                ll = np.stack([reduce_rows(np.add, np.where(inside, own[bucket], np.float32(0)), word_at, 0) for own in logs], 1) if len(starts) else np.zeros((0, len(langs)), np.float32)
                parts.append(_mixtures(ll, row_at, penalty))
                parts[-1][np.diff(row_at) == 0] = 0
                # bytes from 128 on may be no letters: look at texts that have no a-z
                ascii_letters = np.add.reduceat(np.append(((data[offsets[first]:offsets[last]] | 32) - 97) < 26, 0).astype(np.int64), np.minimum(at[:-1], at[-1])) if len(data) else np.zeros(last - first, np.int64)
                for i in np.flatnonzero((ascii_letters == 0) | (np.diff(at) == 0)):
                    if not any(c.isalpha() for c in texts[first + int(i)].as_py() or ""):
                        parts[-1][i] = 0
            share = np.concatenate(parts) if parts else np.zeros((0, len(langs)), np.float32)
            full = share if share.shape[1] else np.zeros((len(share), 1), np.float32)
            top, score = full.argmax(1), full.max(1, initial=0)
            order = np.argsort(-full, axis=1, kind="stable")
            kept = [[int(k) for k in o if full[i, k] > 0] for i, o in enumerate(order)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[np.where(score > 0, top, len(langs))], pa.string()), pa.array(np.minimum(score, 1).astype(np.float64)),
                 pa.array([[langs[k] for k in ks] for ks in kept], pa.list_(pa.string())),
                 pa.array([[float(full[i, k]) for k in ks] for i, ks in enumerate(kept)], pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "langs", "proportions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, langs array<string>, proportions array<double>")
