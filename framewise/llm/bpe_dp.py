"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one last token: the token that ends its BPE encoding. An automaton over the
vocabulary gives all tokens that end at a position; the one whose left neighbour is the stored last token of the
remaining prefix, and stays apart from it under all merges, is the last token of this prefix. Whether two tokens stay
apart is told by walking up both merge trees along their common border. Following the stored tokens back from the end of
the word emits its ids.

Defined cases: a null text counts as empty and has no ids; special strings inside a text give their ids; equal rows give
equal ids; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewise.llm.bpe_ids import byte_alphabet, read_vocabulary
from framewise.llm.common import keyed_texts, small_batches

#: White space as the vocabulary's splitting pattern has it (fixed value).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The word pattern of the vocabulary (fixed value).
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
CACHE_PIECES = 300_000
CACHE_PAIRS = 1_000_000
#: Longer words and pieces are not remembered, so that a memory has a bound in bytes too.
CACHE_CHARS = 64
NEVER = 1 << 60

_WORD = regex.compile(WORD)
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Grower(dict):
    """A bounded memory of one function's results."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class PrefixBpe:
    """Encoder and decoder for one vocabulary whose words end with a marked symbol.

    Inside, a byte that ends a word is another symbol than the same byte elsewhere, so a word is a string over 512
    symbols and every token is one string.
    """

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.shown = {i: token for token, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        ids = {self._symbols(token): i for token, i in model["vocab"].items()}
        self.rule: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = self._symbols(left), self._symbols(right)
            self.rule[ids[a], ids[b]] = rank
            self.parts[ids[a + b]] = (ids[a], ids[b])
            self.rank[ids[a + b]] = rank
        self.right_spine = {i: self._spine(i, 1) for i in ids.values()}
        self.left_spine = {i: self._spine(i, 0) for i in ids.values()}
        sound: set[int] = set()
        for i in sorted(ids.values(), key=lambda i: self.rank.get(i, -1)):
            if i not in self.parts or (sound.issuperset(self.parts[i]) and self._apart(*self.parts[i], joined=True)):
                sound.add(i)
        self.automaton = ahocorasick.Automaton()
        for word, i in ids.items():
            if i in sound:
                self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.pair = _Grower(lambda p: self._apart(*p), CACHE_PAIRS)
        self.pieces = _Grower(self._piece, CACHE_PIECES)
        self.words = _Grower(self._word, CACHE_PIECES)

    def _symbols(self, token: str) -> str:
        ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = [self.alphabet[c] for c in (token[: -len(self.suffix)] if ends else token)]
        if ends:
            body[-1] += 256
        return "".join(map(chr, body))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Fragments at one border of a token, from the single symbol up, each with the rank that absorbs it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until, token = self.rank[token], self.parts[token][side]

    def _apart(self, a: int, b: int, joined: bool = False) -> bool:
        """Whether no merge ever crosses the border between two tokens; ``joined`` leaves out the merge of both in full."""
        left, right = self.right_spine[a], self.left_spine[b]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            top = x_until == NEVER and y_until == NEVER
            rank = self.rule.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until and not (top and joined):
                return False
            if top:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def last_tokens(self, symbols: str) -> list[int]:
        """For each prefix length from 0: the token that ends the prefix's encoding (-1 for the empty prefix)."""
        last = [-1] * (len(symbols) + 1)
        length = [0] * (len(symbols) + 1)
        for end, (n, token) in self.automaton.iter(symbols):
            at = end + 1
            if length[at]:
                continue
            before = last[at - n]
            if at == n or self.pair[before, token]:
                last[at], length[at] = token, n
        self._lengths = length
        return last

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256)
        last = self.last_tokens(symbols)
        ids, at = [], len(symbols)
        while at:
            if not self._lengths[at]:
                raise ValueError(f"the vocabulary has no token for a byte of {word[:40]!r}")
            ids.append(last[at])
            at -= self._lengths[at]
        return array("I", ids[::-1]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(piece)))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if _ODD_SPACE.search(text):
            return self._piece(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.special_split.split(text)
        if len(parts) == 1:
            return self._plain(text)
        out = []
        for k, part in enumerate(parts):
            out.append(array("I", [self.special[part]]).tobytes() if k % 2 else self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens as the vocabulary shows them, with a blank between: this vocabulary names no decoder."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join(map(self.shown.__getitem__, numbers))


_made: dict[int, PrefixBpe] = {}


def worker_bpe(vocabulary: bytes) -> PrefixBpe:
    key = hash(vocabulary)
    if key not in _made:
        _made[key] = PrefixBpe(vocabulary)
    return _made[key]


def encode(docs: DataFrame, vocabulary_path: str, *, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (binary: little-endian unsigned 32-bit integers) for each row; on demand ``decoded`` too."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(shared.value)
        for batch in small_batches(batches):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            columns, names = [batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            if decoded:
                columns, names = [*columns, pa.array([bpe.decode(i) for i in ids], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id`` and ``text`` for rows of ``encode``; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(shared.value)
        for batch in small_batches(batches):
            texts = [bpe.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
