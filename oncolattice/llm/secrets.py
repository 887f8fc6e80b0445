"""Secret scans: base patterns in the text, then in every layer that can be decoded from it.

A worklist holds layers: the text, and whatever URL escapes, Unicode escapes, base64 and compressed data in
a layer decode to. Each layer is scanned; a finding is mapped to the characters of the document that it was
decoded from. Layers already seen at the same place are not opened again, so the work ends.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # only whole runs are found, so looking back is safe
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
BASE64 = (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}={0,2}"))
WRAPPED = (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]+)+={0,2}"),
           re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9_-]+)+={0,2}"))
LINE = re.compile(r"[^\s=]+")
BYTE = re.compile(r"""%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])""")
CONTROL = {c: ord(v) for c, v in zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\"")}
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
UTF16 = (re.compile(rb"(?:[^\x00]\x00){6,}"), re.compile(rb"(?:\x00[^\x00]){6,}"))
PIECE = 1 << 20  # bytes of decompressed data looked at together
CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\{}]""")  # in no finding and no encoded run
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")


def scan(text: str) -> list[tuple[int, int, str]]:
    """Base findings of one layer as (start, end, kind)."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class Layer:
    """Decoded text with the place in the document of each of its characters, or one place for all of it."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def over(self, text: str, starts, ends) -> Layer:
        """Layer decoded from this one, given where in it each character comes from."""
        if self.whole:
            return Layer(text, whole=self.whole)
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        if self.starts is None:
            return Layer(text, starts, ends)
        return Layer(text, self.starts[starts], self.ends[ends - 1])


def _spread(raw: bytes, byte_starts, byte_ends):
    """UTF-8 text of the bytes with start and end per character; a byte that is no part of it stands as U+FFFD."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stray = (codes >= 0xDC80) & (codes < 0xDD00)
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    size[stray] = 1
    last = np.cumsum(size) - 1
    if stray.any():
        text = np.where(stray, np.uint32(0xFFFD), codes).astype(np.uint32).tobytes().decode("utf-32-le")
    return text, np.asarray(byte_starts)[last - size + 1], np.asarray(byte_ends)[last]


def _escaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with its escape runs replaced by what they stand for; None if nothing changes."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0], m.start())
        if got is None:
            continue
        text, s, e = got
        keep = np.arange(at, m.start())
        parts += [layer.text[at:m.start()], text]
        starts += [keep, s]
        ends += [keep + 1, e]
        at = m.end()
    if not at:
        return None
    keep = np.arange(at, len(layer.text))
    return layer.over("".join([*parts, layer.text[at:]]), np.concatenate([*starts, keep]), np.concatenate([*ends, keep + 1]))


def _from_url(run: str, at: int):
    places = at + 3 * np.arange(len(run) // 3)
    return _spread(bytes.fromhex(run.replace("%", "")), places, places + 3)


def _from_unicode(run: str, at: int):
    units, starts, ends = [], [], []
    for m in ESCAPE.finditer(run):
        code = int(m[1] or m[2], 16)
        if code > 0x10FFFF:
            return None
        if units and 0xDC00 <= code < 0xE000 and 0xD800 <= units[-1] < 0xDC00:  # a surrogate pair
            units[-1] = 0x10000 + ((units[-1] - 0xD800) << 10) + code - 0xDC00
            ends[-1] = at + m.end()
        else:
            units.append(code)
            starts.append(at + m.start())
            ends.append(at + m.end())
    text = "".join(map(chr, units))
    return None if re.search("[\ud800-\udfff]", text) else (text, np.array(starts), np.array(ends))


class _Inflated(io.RawIOBase):
    """gzip (of one or more members) or zlib data read piece by piece."""

    def __init__(self, source):
        self.source, self.inflate, self.rest = source, zlib.decompressobj(47), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.source.read1(1 << 16)
                if self.rest[:2] != b"\x1f\x8b":
                    return 0
                self.inflate = zlib.decompressobj(47)
            raw = self.rest or self.inflate.unconsumed_tail or self.source.read1(1 << 16)
            self.rest = b""
            got = self.inflate.decompress(raw, len(into))
            if got or not raw:
                into[:len(got)] = got
                return len(got)


def _opened(source: io.BufferedReader) -> io.BufferedReader | None:
    """Reader of the data packed in `source`, None if it is not compressed."""
    head = source.peek(8)[:8]
    if head[:3] == b"\x1f\x8b\x08" or head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return io.BufferedReader(_Inflated(source))
    if head[:3] == b"BZh":
        return io.BufferedReader(bz2.BZ2File(source))
    if head[:6] == b"\xfd7zXZ\x00":
        return io.BufferedReader(lzma.LZMAFile(source))
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(source))
    return None


def _texts(raw: bytes, at: int = 0) -> Iterator[str]:
    """Text of compressed data that begins at a place, layer in layer, in pieces of about `PIECE` bytes that no finding crosses.

    A broken stream gives what its reader passes on before the fault.
    """
    source = io.BytesIO(raw)
    source.seek(at)
    source, depth = io.BufferedReader(source), 0
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    try:
        while (inner := _opened(source)) is not None:
            source, depth = inner, depth + 1
        while depth and (block := source.read1(PIECE)):
            held += decoder.decode(block)
            cut = next((m.end() for m in CUT.finditer(held[::-1])), 0)
            if cut:
                yield held[:len(held) - cut + 1]
                held = held[len(held) - cut + 1:]
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        pass
    if held:
        yield held


def _from_bytes(layer: Layer, raw: bytes, starts: np.ndarray, ends: np.ndarray, stop: int) -> Iterator[Layer]:
    """Layers of bytes decoded from the given places, of a run up to `stop`: compressed data, and UTF-16 text of ASCII characters."""
    for m in PACKED.finditer(raw):
        for text in _texts(raw, m.start()):
            yield Layer(text, whole=layer.place(int(starts[m.start()]), stop))
    for k, pattern in enumerate(UTF16):
        for m in pattern.finditer(raw):
            own = slice(m.start() + k, m.end(), 2)
            yield layer.over(raw[own].decode("latin-1"), starts[m.start():m.end():2], ends[m.start() + 1:m.end():2])


def _unpacked(layer: Layer, places: np.ndarray, stop: int) -> Iterator[Layer]:
    """Layers of the base64 characters at the given places, of a run up to `stop` (with signs of its end)."""
    first, last = int(places[0]), int(places[-1]) + 1
    run = layer.text[first:last] if last - first == len(places) else "".join(map(layer.text.__getitem__, places.tolist()))
    if (run.islower() or run.isalpha() and run.istitle()) and stop == last:
        return  # plain words
    run = run[:-1] if len(run) % 4 == 1 else run
    raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
    at = np.arange(len(raw))
    at = at // 3 * 4 + at % 3
    starts, ends = places[at], places[at + 1] + 1
    ends[-1] = last
    yield from _from_bytes(layer, raw, starts, ends, stop)
    yield layer.over(*_spread(raw, starts, ends))


def _wrapped(layer: Layer) -> Iterator[tuple[np.ndarray, int]]:
    """Places and end of base64 runs that go over line breaks: all lines, all but the first (which may be a word before
    the data), and stretches of lines of one length with the shorter line after them."""
    for pattern in WRAPPED:
        for m in pattern.finditer(layer.text):
            lines = [x.span() for x in LINE.finditer(layer.text, m.start(), m.end())]
            groups, begin = {(0, len(lines)), (1, len(lines))}, 0
            for k in range(1, len(lines) + 1):
                size = lines[begin][1] - lines[begin][0]
                if k == len(lines) or lines[k - 1][1] - lines[k - 1][0] < size or lines[k][1] - lines[k][0] > size:
                    groups.add((begin, k))
                    begin = k
            for first, last in sorted(groups):
                if last - first > 1:
                    yield np.concatenate([np.arange(*x) for x in lines[first:last]]), m.end() if last == len(lines) else lines[last - 1][1]


def _byte_runs(layer: Layer, pattern: str, sign: str) -> Iterator[Layer]:
    """Compressed data and UTF-16 text in runs (of `pattern`) of characters and escaped bytes."""
    for m in re.finditer(pattern, layer.text):
        if sign not in m[0]:
            continue
        raw, starts, at = bytearray(), [], 0
        for x in BYTE.finditer(m[0]):
            if (sign == "%") != (x[1] is not None):
                continue
            raw += m[0][at:x.start()].encode()
            starts += range(at, x.start())
            raw.append(CONTROL[x[3]] if x[3] else int(x[1] or x[2], 16))
            starts.append(x.start())
            at = x.end()
        raw += m[0][at:].encode()
        starts = np.array([*starts, *range(at, len(m[0])), len(m[0])]) + m.start()
        for each in {bytes(raw), bytes(raw if sign != "%" else _spaces(m[0], raw, starts - m.start()))}:
            yield from _from_bytes(layer, each, starts[:-1], starts[1:], m.end())


def _spaces(run: str, raw: bytearray, starts: np.ndarray) -> bytes:
    """The bytes with spaces for the plus signs that are not escaped, as in forms."""
    return bytes(0x20 if b == 0x2B and run[i] == "+" else b for b, i in zip(raw, starts.tolist()))


def _inner(layer: Layer) -> Iterator[Layer]:
    """What a layer decodes to, one at a time."""
    if "%" in layer.text and (new := _escaped(layer, URL, _from_url)):
        yield new
    if "\\" in layer.text and (new := _escaped(layer, UNICODE, _from_unicode)):
        yield new
    if "%" in layer.text:
        yield from _byte_runs(layer, r"[\x21-\x7e]+", "%")
    if "\\x" in layer.text:
        yield from _byte_runs(layer, r"[\x20-\x7e]+", "\\x")
    for start, end in sorted({m.span() for p in BASE64 for m in p.finditer(layer.text)}):
        bare = len(layer.text[start:end].rstrip("="))
        yield from _unpacked(layer, np.arange(start, start + bare), end)
    if "\n" in layer.text:
        for places, stop in _wrapped(layer):
            yield from _unpacked(layer, places, stop)


def findings(text: str) -> tuple[list, list]:
    """Base findings and all findings (base ones, then those of decoded layers) of a whole text."""
    base = scan(text)
    extra, seen = set(base), set()
    work = [_inner(Layer(text))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif new.text:
            key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), new.place(0, len(new.text)))
            if key not in seen:
                seen.add(key)
                extra.update((*new.place(s, e), kind) for s, e, kind in scan(new.text))
                work.append(_inner(new))
    order = lambda f: (f[0], KINDS.index(f[2]), f[1])
    return sorted(base, key=order), sorted(extra, key=order)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id, base and spans as arrays of (start, end, kind), by start and kind.

    Places are code points of the document, end exclusive; a finding in a decoded layer covers the
    characters that it was decoded from (all of a run, if compressed). spans holds base and all others.
    Null and empty texts have none. Each row stands for itself, repeated or not, with any id. Layers are opened one
    at a time, and compressed data is read in pieces, so a small text that swells takes little memory; only
    a piece without any character that ends a finding grows on.
    """
    span = "array<struct<start: long, end: long, kind: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            both = [findings(t) if t else ([], []) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), f)) for f in x[k]] for x in both], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, base {span}, spans {span}")
