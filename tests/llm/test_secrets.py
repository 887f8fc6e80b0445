"""Layers that are wrapped, binary, UTF-16 or written as escaped bytes."""

import base64
import bz2
import gzip
import random
import textwrap
import urllib.parse
import zlib

import pytest

from oncolattice.llm import secrets

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
INNER = f"password = hunter2secret and {KEY}"
NOISE = "é".join(f"{i * 7919 % 1000003} line" for i in range(40))


def kinds(text):
    return {k for _, _, k in secrets.findings(text)[1]}


@pytest.mark.parametrize("columns", [64, 76])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
def test_wrapped_base64(columns, newline):
    for body in ((NOISE + INNER + NOISE).encode(), gzip.compress((NOISE + INNER + NOISE).encode()), b"\xff" * 40 + INNER.encode() * 3):
        for shift in range(4):
            lines = newline.join(textwrap.wrap(base64.b64encode(b"\x01" * shift + body if body[:2] != b"\x1f\x8b" else body).decode(), columns))
            for before in ("-----BEGIN DATA-----\n", "Internationalizations\n", "data: ", "mail part follows here\n\n"):
                text = before + lines + "\nThe end of it.\n"
                assert {"assign", "access"} <= kinds(text), (columns, newline, before, shift)
    text = "x\n" + "\n".join(textwrap.wrap(base64.b64encode(b"0" * 50 + b" " + KEY.encode() + b" " + b"1" * 50).decode(), 76)) + "\n"
    s, e, _ = next(f for f in secrets.findings(text)[1] if f[2] == "access")
    assert "\n" in text[s:e] and len(text[s:e]) < 32


def test_binary_and_utf16():
    for raw in (INNER.encode("utf-16-le"), INNER.encode("utf-16"), INNER.encode("utf-16-be"), b"\x1b[0m" + INNER.encode() + b"\0", b"\x80\xff\x00" + INNER.encode() + b"\xfe",
                b"head" + gzip.compress(INNER.encode())):
        packed = base64.b64encode(raw).decode()
        found = secrets.findings(f"é -enc {packed} z")[1]
        assert {"assign", "access"} <= {k for *_, k in found} and all(7 <= s < e <= 7 + len(packed) + 1 for s, e, _ in found), raw
    s, e, _ = next(f for f in secrets.findings("é %FF%41%4B%49%41" + KEY[4:] + " z")[1])
    assert (s, e) == (5, 5 + 12 + 16)


def test_compressed_data_in_escaped_bytes():
    random.seed(1)
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        raw = pack((INNER + NOISE).encode())
        for text in (urllib.parse.quote(raw), urllib.parse.quote_plus(raw), "".join(f"%{b:02X}" for b in raw), "".join(f"\\x{b:02x}" for b in raw), repr(raw), "d=" + urllib.parse.quote(raw) + "&x=1"):
            assert {"assign", "access"} <= kinds(f"é {text} z"), (pack, text[:40])


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "%", "%41" * 100_000, "\\x41" * 50_000, ("A" * 76 + "\n") * 4000, "x\x01%78%01" * 20_000):
        secrets.findings(text)
