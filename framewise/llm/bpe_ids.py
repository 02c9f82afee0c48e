"""Token ids of a byte-level BPE vocabulary file, cached by white-space separated piece inside each Python worker.

A text may be cut before any blank that follows a non-blank character: the splitting pattern lets no token start before
such a blank and end after it, and looks ahead only inside runs of white space. So the ids of a text are those of its
pieces, one after the other, and a piece that was seen before costs one lookup. A text with a blank between two other
white-space characters goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import tiktoken
from tokenizers import Tokenizer

#: The splitting pattern of the byte-level pre-tokenizer (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers; when there are more, it starts anew.
CACHE_PIECES = 200_000
#: Longer pieces are not remembered, so that the memory has a bound in bytes too.
CACHE_CHARS = 64
_UNSAFE = re.compile(r"\s \s")
#: Characters on whose classes every splitter agrees: printable ASCII, Latin letters with marks, and line ends.
_PLAIN = re.compile(r"[\x20-\x7e\n\tÀ-ÖØ-öø-ſ]*")


def byte_alphabet() -> dict[str, int]:
    """Byte of each printable stand-in: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of each piece after a blank, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit integers, exactly as the tokenizers library gives them."""

    def __init__(self, vocabulary: bytes, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.full.no_truncation()
        self.full.no_padding()
        spec = json.loads(vocabulary)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.quick = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.piece, cache_pieces)

    def _slow(self, text: str) -> bytes:
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a text without any cache."""
        if _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return array("I", self.quick.encode_ordinary(text)).tobytes()
        return self._slow(text)

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._slow(text)
        first, *rest = text.split(" ")
        return b"".join([self.piece(first), *map(self.pieces.__getitem__, rest)])


_encoders: dict[int, PieceEncoder] = {}


def worker_encoder(vocabulary: bytes) -> PieceEncoder:
    """The encoder of this Python worker, made once for each vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(vocabulary)
    return _encoders[key]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file of fixed size, read where the job is planned; executors get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()
