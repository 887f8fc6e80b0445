"""Token counts by a count-only Viterbi pass over a unigram vocabulary."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import MARK, MODEL, Vocabulary, chunked, load, marked

PENALTY = 10.0     # an unknown character scores this much less than the least piece
REMEMBERED = 400_000  # chunks whose counts a worker keeps; only speed depends on it


class Counter:
    """Pieces and score of the best segmentation.

    An Aho-Corasick automaton gives the pieces ending at each character, longest first. For each end the
    best score so far and its piece count are carried; a later candidate must be strictly better, so of equal
    ones that with the earliest start holds, as in the tokenizer. A character that no single-character piece
    covers may also be unknown; a run of unknown ones is written in bytes, one piece each. Scores are doubles.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.least - PENALTY
        self.cuts = vocabulary.cuts
        self.known: dict[str, tuple[int, float]] = {}

    def chunk(self, chunk: str) -> tuple[int, float]:
        text, marks = marked(chunk)
        n, count, best, last, unknown = len(text), [0], [0.0], 0, self.unknown
        odd = MARK in text[marks:]  # a mark of the text itself is no space: no piece covers it

        def lone(end: int) -> None:
            """The character at `end` as unknown, where nothing else ends there."""
            best.append(best[end] + unknown)
            count.append(count[end] + len(text[end].encode("utf-8", "surrogatepass")))

        score, pieces, single = None, 0, False
        for end, (length, own) in self.automaton.iter(text):
            if end != last:  # matches come by their ends
                if score is not None:
                    self.close(text, last, score, pieces, single, best, count)
                    last += 1
                while last < end:
                    lone(last)
                    last += 1
                score, single = None, False
            start = end + 1 - length
            if odd and (MARK in text[max(start, marks):end + 1]):
                continue
            single = single or length == 1
            value = best[start] + own
            if score is None or value > score:
                score, pieces = value, count[start] + 1
        if score is not None:
            self.close(text, last, score, pieces, single, best, count)
            last += 1
        while last < n:
            lone(last)
            last += 1
        return count[n], best[n]

    def close(self, text, end, score, pieces, single, best, count) -> None:
        """Settle the end: a character without a piece of its own may also be unknown, if that scores more."""
        if not single and best[end] + self.unknown > score:
            score, pieces = best[end] + self.unknown, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
        best.append(score)
        count.append(pieces)

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces of a whole text and their score; none for null and the empty text."""
        known, n, total = self.known, 0, 0.0
        for chunk in chunked(text, self.cuts) if text else ():
            got = known.get(chunk)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[chunk] = self.chunk(chunk)
            n += got[0]
            total += got[1]
        return n, total


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_tokens, score (of the best segmentation).

    Spaces become marks with one put before the text, and nothing else is normalised. Null and empty texts have 0
    tokens. Texts are cut where no piece of the vocabulary can cross (before spaces, between letters and most
    signs), so each stretch is segmented by itself and remembered; the sums are those of the whole text. Each row
    stands for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            n, score = zip(*map(counter.text, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, score double")
