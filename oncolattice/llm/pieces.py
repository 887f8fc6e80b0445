"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, hand_back, mix, number_hash, text_bytes
from .vocabulary import MARK, MODEL, Vocabulary, load, marked

REMEMBERED = 200_000   # segmentations that a worker keeps; only speed depends on it
BLOCK = 1 << 18       # chunks whose segmentations are looked up together
LEARNED = 1 << 13     # chunks whose agendas advance together
GROUP = 1 << 20       # bytes of texts encoded together
SHORT = 40            # characters up to which chunks advance together; longer ones go one by one
LAST = np.iinfo(np.int32).max
WIDTHS = (8, 14, SHORT)  # chunks that advance together have at most so many characters

_letters = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Which code points are letters for the cutting pattern: word characters but digits and underscores."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)
    return _letters


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: np.dtype):
        self.n, self.values = 0, np.empty(1 << 10, kind)

    def extend(self, more) -> None:
        end = self.n + len(more)
        if end > len(self.values):
            self.values = np.concatenate([self.values[:self.n], np.empty(max(end, 3 * self.n // 2) - self.n, self.values.dtype)])
        self.values[self.n:end] = more
        self.n = end

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.values[at]


class Encoder:
    """Merges by an agenda: the best-scoring, then leftmost pair first. Every candidate merge taken from the agenda is
    skipped with the chance `dropout`, drawn anew for each occurrence of a chunk: a keyed hash of (seed, document, place of
    the chunk in it) gives the gaps between the skipped candidates. So the same key always gives the same pieces, and no
    number of segmentations is fixed. What one set of skips makes of a chunk is remembered: a node is a chunk with its first
    skips, known with its ids and the number of candidates that it takes; a skip below that number leads to a further node.
    Characters without a piece are written in bytes."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0, dropout: float = 0.1):
        self.ids = {piece: i for piece, (i, _) in vocabulary.pieces.items()}
        self.cost = {piece: -score for piece, (_, score) in vocabulary.pieces.items()}
        self.bytes_at, self.cuts = vocabulary.bytes_at, vocabulary.cuts
        self.seed, self.dropout = number_hash(seed), dropout
        self.rate = math.log1p(-dropout) if dropout < 1 else -math.inf
        self.forget()
        # symbols are numbers: a piece's id, or beyond them a character that is no piece but in one
        symbols = self.ids | {c: len(vocabulary.raw) + ord(c) for p in self.ids for c in p if c not in self.ids}
        singles = sorted((ord(" ") if c == MARK else ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.codes, self.numbers = (np.array(x, np.int64) for x in zip(*singles))
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        merges = sorted((symbols[p[:k]] << 21 | symbols[p[k:]], ranks[self.cost[p]], i) for p, i in self.ids.items()
                        for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pairs, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*merges)) if merges else [np.full(1, -1, np.int64)] * 3
        # open addressing: a slot has the row of a pair, or -1
        self.bits = max(4, 2 + len(merges).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        for row, (pair, *_) in enumerate(merges):
            slot = (pair * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
            while self.slots[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.slots[slot] = row
        self.lines = vocabulary.lines
        self.stops = np.zeros(0x110000, bool)
        self.stops[[ord(c) for c in vocabulary.stops]] = True

    def forget(self) -> None:
        self.roots: dict[str, int] = {}     # node of a chunk without skips
        self.further: dict[int, int] = {}   # node << 7 | next skipped candidate -> node
        # of each node: its candidates (below 3 * SHORT), how many ids it has, and where they are among all ids
        self.taken, self.size, self.at, self.flat = (_Grown(np.dtype(x)) for x in (np.uint8, np.int32, np.int64, np.int32))

    def gaps(self, keys: np.ndarray, depth) -> np.ndarray:
        """Candidates between one skipped candidate and the next (number `depth`) of each key."""
        hashed = mix(keys ^ mix(np.atleast_1d(np.asarray(depth, np.uint64))))
        chance = ((hashed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        return np.minimum(np.log(chance) / self.rate, 2.0**40).astype(np.int64)

    def skips(self, key: int, n: int) -> list[int]:
        """The skipped ones among n candidates."""
        gaps = self.gaps(np.full(n, key, np.uint64), np.arange(1, n + 1)) if self.dropout else np.zeros(0, np.int64)
        at = np.cumsum(gaps + 1) - 1
        return at[at < n].tolist()

    def learn(self, chunks: list[str], skips: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Ids of many chunks, given the skipped candidates of each (a row of `skips`), and how many candidates were taken:
        all agendas advance together, each by its next merge."""
        out: list = [None] * len(chunks)
        taken = np.zeros(len(chunks), np.int64)
        skips = np.pad(skips, ((0, 0), (0, 1)), constant_values=LAST)
        lengths = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.cumsum(lengths) - lengths
        where = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        plain = np.logical_and.reduceat(self.codes[where] == codes, at) & (lengths <= SHORT)
        for i in np.flatnonzero(~plain):
            out[i], taken[i] = self.chunk(chunks[i], skips[i].tolist())
        symbols, least = self.numbers[where], 0
        for width in WIDTHS:
            some = np.flatnonzero(plain & (lengths > least) & (lengths <= width))
            if len(some):
                inside = np.arange(width) < lengths[some][:, None]
                table = np.full(inside.shape, -1, np.int64)
                table[inside] = symbols[(at[some][:, None] + np.arange(width))[inside]]
                ids, ends, taken[some] = self.advance(table, inside, skips[some])
                raw = ids.astype(np.int32).tobytes()
                start = 0
                for i, end in zip(some.tolist(), (4 * ends).tolist()):
                    out[i] = raw[start:end]
                    start = end
            least = width
        return out, taken.tolist()

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and table row of pairs of symbols; a right one below zero makes no pair."""
        key = left << 21 | right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.slots[slot]
        todo = np.flatnonzero((row >= 0) & (self.pairs[row] != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            row[todo] = self.slots[slot[todo]]
            todo = todo[(row[todo] >= 0) & (self.pairs[row[todo]] != key[todo])]
        return np.where((row >= 0) & (right >= 0), self.ranks[row], LAST), row

    def advance(self, sym: np.ndarray, inside: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left of each row, all together, where each row's end, and the candidates taken; symbols of a row are linked left and right."""
        n, width = sym.shape
        taken, passed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.arange(n * width).reshape(n, width)
        after = np.where(np.pad(inside[:, 1:], ((0, 0), (0, 1))), place + 1, -1).ravel()
        before = np.where(np.arange(width) > 0, place - 1, -1).ravel()
        rank, row = np.full(n * width, LAST, np.int32), np.zeros(n * width, np.int64)
        sym = sym.ravel()
        first = np.flatnonzero(after >= 0)
        rank[first], row[first] = self.found(sym[first], sym[first + 1])
        table, live = rank.reshape(n, width), np.arange(n)
        while len(live):
            here = table[live]
            best = here.argmin(1)  # the leftmost of equal ones
            open_ = here[np.arange(len(live)), best] < LAST
            live = live[open_]
            at = live * width + best[open_]
            skip = skips[live, passed[live]] == taken[live]
            taken[live] += 1
            if skip.any():
                passed[live[skip]] += 1
                rank[at[skip]] = LAST
                at = at[~skip]
            gone = after[at]
            sym[at] = self.merged[row[at]]
            sym[gone], rank[gone] = -1, LAST
            then = after[gone]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            back = before[at]
            back, onto = back[back >= 0], at[back >= 0]
            i = np.concatenate([at, back])
            rank[i], row[i] = self.found(sym[i], np.concatenate([np.where(then >= 0, sym[then], -1), sym[onto]]))
        left = (sym >= 0).reshape(n, width)
        return sym[left.ravel()], np.cumsum(left.sum(1)), taken

    def chunk(self, chunk: str, skips: list[int]) -> tuple[bytes, int]:
        """Ids of one chunk, of any length and with any characters, and the number of candidates taken."""
        text, marks = marked(chunk)
        skips, taken = set(skips), 0
        out: list[str] = []
        at = 0
        while at < len(text):  # a mark of the text itself is no space: it is written in bytes and merges with nothing
            stop = text.find(MARK, max(at, marks))
            stop = len(text) if stop < 0 else stop
            if stop > at:
                pieces, taken = self.merge(text[at:stop], skips, taken)
                out += pieces
            if stop < len(text):
                out.append("")
            at = stop + 1
        ids, known = array("i"), self.ids
        for piece in out:
            got = known.get(piece)
            if got is not None:
                ids.append(got)
            else:
                ids.extend([self.bytes_at + x for x in (piece or MARK).encode("utf-8", "surrogatepass")])
        return ids.tobytes(), taken

    def merge(self, text: str, skips: set[int], taken: int) -> tuple[list[str], int]:
        """Symbols left of a text, when `taken` candidates of its chunk came before, and the candidates taken after it."""
        cost, n = self.cost.get, len(text)
        end = list(range(1, n + 1))      # of the symbol starting here; 0 once it is merged into another
        before = list(range(-1, n - 1))  # start of the symbol to the left
        agenda: list = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                got = cost(text[left:end[right]])
                if got is not None:
                    heapq.heappush(agenda, (got, left, right, end[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, stop = heapq.heappop(agenda)
            if not end[left] or end[left] != right or end[right] != stop:
                continue
            taken += 1
            if taken - 1 in skips:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
            offer(before[left], left)
            offer(left, stop)
        out, i = [], 0
        while i < n:
            out.append(text[i:end[i]])
            i = end[i]
        return out, taken

    def store(self, made: list[bytes], taken) -> np.ndarray:
        """New nodes with these ids."""
        first, size = self.size.n, np.fromiter(map(len, made), np.int64, len(made)) // 4
        self.at.extend(self.flat.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.taken.extend(taken)
        self.flat.extend(np.frombuffer(b"".join(made), np.int32))
        return np.arange(first, self.size.n)

    def add(self, chunks: list[str], skips: np.ndarray) -> np.ndarray:
        """New nodes of chunks with the skipped candidates of each."""
        nodes = []
        for at in range(0, len(chunks), LEARNED):
            made, taken = self.learn(chunks[at:at + LEARNED], skips[at:at + LEARNED])
            # without dropout nothing is looked up by it
            nodes.append(self.store(made, taken if self.dropout else np.zeros(len(taken))))
        return np.concatenate(nodes)

    def block(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of each chunk, given the keys of their occurrences."""
        ids, sizes = self.segment(chunks, keys)
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]

    def segment(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in one array, and how many each has."""
        if self.size.n > REMEMBERED:
            self.forget()
        node = np.array(list(map(self.roots.get, chunks, repeat(-1))), np.int64)
        gaps = np.flatnonzero(node < 0)
        if len(gaps):
            some = [chunks[i] for i in gaps.tolist()]
            if self.dropout and any(len(c) > SHORT for c in some):  # these are not looked up; n characters offer less than 3 * n candidates
                short = np.array([len(c) <= SHORT for c in some])
                long = gaps[~short]
                node[long] = self.store([self.chunk(chunks[i], self.skips(int(keys[i]), 3 * len(chunks[i])))[0] for i in long.tolist()], np.zeros(len(long)))
                gaps, some = gaps[short], [c for c in some if len(c) <= SHORT]
            new = list(dict.fromkeys(some))
            if new:
                self.roots.update(zip(new, self.add(new, np.zeros((len(new), 0), np.int64)).tolist()))
                node[gaps] = list(map(self.roots.get, some))
        if self.dropout:
            at, depth = self.gaps(keys, 1), 1
            go = np.flatnonzero(at < self.taken[node])
            while len(go):
                way = node[go] << 7 | at[go]
                got = np.array(list(map(self.further.get, way.tolist(), repeat(-1))), np.int64)
                miss = np.flatnonzero(got < 0)
                if len(miss):
                    new, one = np.unique(way[miss], return_index=True)
                    rows = go[miss[one]]
                    skips = np.cumsum(np.stack([self.gaps(keys[rows], d) + 1 for d in range(1, depth + 1)], 1), 1) - 1
                    made = self.add([chunks[i] for i in rows.tolist()], skips)
                    self.further.update(zip(new.tolist(), made.tolist()))
                    got[miss] = made[np.searchsorted(new, way[miss])]
                node[go] = got
                depth += 1
                at[go] += self.gaps(keys[go], depth) + 1
                go = go[at[go] < self.taken[node[go]]]
        size = self.size[node].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.arange(size.sum()) + np.repeat(self.at[node] - (ends - size), size)], size

    def cut(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Chunks of all texts in order, as `chunked` has them, and how many each text has."""
        whole = "".join([" " + text for text in texts if text])
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        sizes = np.array([len(text) + 1 if text else 0 for text in texts])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        space, line = codes == 32, (codes == 10) if self.lines else np.zeros(len(codes), bool)
        letter = letters()[codes]
        first = np.ones(len(codes), bool)
        first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        # a word's first letters end where one of the stops follows them
        last = np.maximum.accumulate(np.where(letter, 0, np.arange(len(codes))))[:-1]
        first[1:] |= self.stops[codes[1:]] & letter[:-1] & (space | line)[last]
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        at = np.flatnonzero(first)
        n = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))
        at = at.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:] + [len(whole)])], n

    def texts(self, texts: list, salts: list) -> list[bytes]:
        """Ids of whole texts as 32-bit numbers; a salt (say, the document's id) and the text set what is skipped in it."""
        flat, n = self.cut(texts)
        ends = np.cumsum(n)
        own = np.array([number_hash(salt ^ self.seed ^ number_hash(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))) for text, salt in zip(texts, salts)], np.uint64)
        keys = mix(np.repeat(own, n) + (np.arange(len(flat)) - np.repeat(ends - n, n)).astype(np.uint64)) if flat else np.zeros(0, np.uint64)
        if not flat:
            return [b""] * len(texts)
        ids, sizes = (np.concatenate(x) for x in zip(*[self.segment(flat[at:at + BLOCK], keys[at:at + BLOCK]) for at in range(0, len(flat), BLOCK)]))
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def text(self, text: str | None, salt: int = 0) -> bytes:
        return self.texts([text], [salt])[0]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(r) for r in vocabulary.raw])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(vocabulary.raw), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        """Bytes of a text from its ids, without the space put before it."""
        n = self.size[ids]
        where = np.arange(n.sum()) + np.repeat(self.at[ids] - (np.cumsum(n) - n), n)
        return self.flat[where].tobytes()[1:]


def _encoded(batches, encoder: Encoder, decoder: Decoder):
    """Rows of `encode` for batches of (id, text), handed on by groups, so that a worker holds no whole batch of results."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for first, last in chunks(offsets, GROUP):
            ids, texts = (batch.column(k).slice(first, last - first) for k in (0, 1))
            made = encoder.texts(texts.to_pylist(), [i or 0 for i in ids.to_pylist()])
            n = np.array([len(m) // 4 for m in made], np.int32)
            whole = [decoder.raw(np.frombuffer(m, np.int32)) == data[a:b].tobytes() for m, a, b in zip(made, offsets[first:last], offsets[first + 1:last + 1])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), np.int32)))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(n.astype(np.int64)), pa.array(whole, pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])


def encode(docs: DataFrame, model: str = MODEL, seed: int = 0, dropout: float = 0.1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: doc_id, ids, n_pieces, lossless (decoding gives the text's bytes again).

    With dropout 0 these are the model's own pieces; with more, each candidate merge is skipped with that
    chance in each occurrence of a word, settled by a hash of seed, id, text and place, so that a seed always gives the
    same result and another one different pieces. Null and empty texts have no pieces. Each row stands for itself;
    equal rows have equal pieces; a null id counts as 0 in the hash.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        yield from _encoded(batches, Encoder(shared.value, seed, dropout), Decoder(shared.value))
        hand_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [decoder.raw(np.array(i or [], np.int32)).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
