"""Encoding with a public vocabulary: whole texts, by pieces between spaces, each distinct piece encoded once.

Neither of the two pre-tokenizers used here lets a token run from other characters into white space, so a text may be
cut before white space without changing its ids; where two stand together, only before a space that follows another
character. A single newline is a token of its own or dropped. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces with their ids fill one memory up to this number; then it takes the place of an older one and starts anew,
#: so what is met often stays. Longer pieces aren't kept.
KEPT_PIECES, KEPT_CHARS = 300_000, 64
MARKS = (",", ".", ";", ":", "!", "?")
#: Letters before this one have one lower-case form and no combining parts.
LATIN_END = "\u0250"
_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBLE = re.compile(r"\s\s")
_loaded: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it prints in Latin-1, and as the next free letter from 256 on if not."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # a text that spells a control token gets its id, as the library has it
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        parts = [x["type"] for x in before.get("pretokenizers", [])]
        self.kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "spaced"  # a space belongs to the word after it
        elif parts == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("invert") and "[^\\s\\p{L}" in before["pretokenizers"][0]["pattern"].get("Regex", ""):
            self.kind = "bare"  # white space is dropped
        self.memory, self.old = _Memory(self), {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _direct(self, pieces: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encode(pieces, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        if self.kind == "bare":
            return text.replace("\n", " ").split(" ")
        if _DOUBLE.search(text):
            return _CUT.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece. A run of Latin letters is one word to the merges; a mark after letters is a word of its own."""
        spaced = self.kind == "spaced" and piece[:1] == " "
        word = piece[1:] if spaced else piece
        small = word if self.kind == "spaced" else word.lower()  # which is letters and marks for a dotted capital I
        if small.isalpha() and max(small) < LATIN_END:
            raw = small.encode().decode("latin-1").translate(BYTE_LETTERS)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(BYTE_LETTERS[32] * spaced + raw)]).tobytes()
        if small[-1:] in MARKS and small[:-1].isalpha() and max(small[:-1]) < LATIN_END:
            return self.memory[piece[:-1]] + self.memory[piece[-1]]
        return self._direct([piece])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.kind == "whole":
            return self._direct([t or "" for t in texts])
        out = [b"".join(map(self.memory.__getitem__, self.pieces(text or ""))) for text in texts]
        if len(self.memory) > KEPT_PIECES:
            self.old, self.memory = self.memory, _Memory(self)
        return out


class _Memory(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = dict.get(self.encoder.old, piece)
        if ids is None:
            ids = self.encoder.piece(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids
