"""Pieces and scores of a SentencePiece model file, and cutting of texts where no piece can cross."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """pieces maps normal pieces to (id, score); bytes_at is the id of the piece of byte 0."""
    pieces: dict[str, tuple[int, float]]
    raw: list[bytes]            # what each id stands for, spaces for marks
    bytes_at: int
    least: float = field(init=False)
    cuts: re.Pattern = field(init=False)
    stops: str = field(init=False)   # a text may be cut between a word's first letters and one of these
    lines: bool = field(init=False)  # a line end stands alone

    def __post_init__(self):
        self.least = min(score for _, score in self.pieces.values())
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark after other characters; texts can't be cut at spaces")
        # a text may be cut between a letter and what follows a letter in no piece, and around a character in no piece
        after = {y for p in self.pieces for x, y in zip(p, p[1:]) if x.isalpha()}
        self.stops = "".join(c for c in string.punctuation + string.digits if c not in after)
        self.lines = not any("\n" in p for p in self.pieces)
        signs, line = "".join(map(re.escape, self.stops)), "\\n" if self.lines else ""
        stops = f"{signs}{line}"
        self.cuts = re.compile((rf" *[^\W\d_]+(?=[{stops}])|" if stops else "") + rf" +[^ {line}]*|[^ {line}]+" + (r"|\n" if line else ""))


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw, bytes_at = {}, [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at = i if piece == "<0x00>" else bytes_at
            raw.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            raw.append(piece.replace(MARK, " ").encode())
    if bytes_at is None:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(pieces, raw, bytes_at)


def chunked(text: str, cuts: re.Pattern) -> list[str]:
    """Stretches that no piece crosses, in order; a space is put before the text. Spaces are only at their start."""
    return cuts.findall(" " + text) if text else []


def marked(chunk: str) -> tuple[str, int]:
    """The chunk with its leading spaces as marks, and how many there are; a mark in the text stays as it is."""
    word = chunk.lstrip(" ")
    return MARK * (len(chunk) - len(word)) + word, len(chunk) - len(word)
