"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the lengths (in tokens) of frequent pre-tokens, broadcast once: open addressing over
numpy arrays of key hashes, key offsets into one byte string, and lengths. Tier two encodes what tier one lacks and
remembers it in the Python worker. No pre-token is ever shuffled, and the counts are exact whatever the table holds:
it is filled from a bounded sample of documents and decides the speed only.

Defined cases: a null text counts as empty and has 0 tokens; an empty table gives an empty table; repeated rows are
counted one by one; special strings inside a text count as the one token the library makes of them. Only ``doc_id`` and
``text`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.bpe_ids import CACHE_CHARS, PATTERN, read_vocabulary, worker_encoder
from framewise.llm.common import keyed_texts, small_batches

#: Texts (most, and longest) from which frequent pre-tokens are taken, so at most 32 MB; entries of the broadcast table.
SAMPLE_DOCUMENTS = 2000
SAMPLE_TEXT_BYTES = 16 << 10
TABLE_ENTRIES = 32768
#: Pre-tokens a worker remembers; when there are more, it starts anew.
CACHE_PRE_TOKENS = 400_000
LIMIT = 512

_SPLIT = regex.compile(PATTERN)


class LengthTable:
    """Open-addressing table from pre-token bytes to token count; keys are compared in full, so it never errs."""

    def __init__(self, lengths: dict[bytes, int]):
        size = 1 << max(4, (2 * len(lengths)).bit_length())
        self.mask = size - 1
        self.at = np.full(size, -1, np.int32)
        self.count = np.zeros(len(lengths), np.uint16)
        self.end = np.zeros(len(lengths) + 1, np.int32)
        keys = []
        for i, (key, n) in enumerate(lengths.items()):
            slot = xxhash.xxh3_64_intdigest(key) & self.mask
            while self.at[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.at[slot], self.count[i], self.end[i + 1] = i, n, self.end[i] + len(key)
            keys.append(key)
        self.keys = b"".join(keys)

    def get(self, key: bytes) -> int:
        """Token count of a key; -1 if the table lacks it."""
        slot = xxhash.xxh3_64_intdigest(key) & self.mask
        while (i := int(self.at[slot])) >= 0:
            if self.keys[self.end[i] : self.end[i + 1]] == key:
                return int(self.count[i])
            slot = (slot + 1) & self.mask
        return -1


class _Lengths(dict):
    """Worker cache of token counts: a pre-token that is new is looked up in the table, and encoded if that lacks it."""

    def __init__(self, table: LengthTable, encode):
        super().__init__()
        self.table, self.encode = table, encode

    def __missing__(self, pre_token: str) -> int:
        n = self.table.get(pre_token.encode("utf-8", "surrogatepass"))
        if n < 0:
            n = len(self.encode(pre_token)) // 4
        if len(pre_token) <= CACHE_CHARS:
            if len(self) >= CACHE_PRE_TOKENS:
                self.clear()
            self[pre_token] = n
        return n


#: The worker caches, by a key of the vocabulary.
_caches: dict[int, _Lengths] = {}


def frequent_lengths(docs: DataFrame, vocabulary: bytes) -> LengthTable:
    """Table of the most frequent pre-tokens of a bounded sample: the different texts with the least hashes.

    Hashes are reduced before anything moves, and of equal texts one is read, however many rows repeat it.
    """
    texts = keyed_texts(docs).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).select(F.xxhash64("text").alias("h"), "text")
    drawn = texts.select("h").distinct().orderBy(F.xxhash64("h", F.lit("lengths")), "h").limit(SAMPLE_DOCUMENTS)
    chosen = docs.sparkSession.createDataFrame(drawn.collect(), "h long")
    rows = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).collect()
    counts: Counter[str] = Counter()
    for row in rows:
        counts.update(_SPLIT.findall(row.text))
    encoder = worker_encoder(vocabulary)
    return LengthTable({w.encode("utf-8"): len(encoder.piece(w)) // 4 for w, _ in counts.most_common(TABLE_ENTRIES)})


def count_tokens(docs: DataFrame, vocabulary_path: str, *, limit: int = LIMIT, table: LengthTable | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row, in one pass and without any exchange."""
    vocabulary = read_vocabulary(vocabulary_path)
    context = docs.sparkSession.sparkContext
    table = table or frequent_lengths(docs, vocabulary)
    shared = context.broadcast((vocabulary, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = shared.value
        encoder = worker_encoder(vocabulary)
        lengths = _caches.setdefault(hash(vocabulary), _Lengths(table, encoder.piece))
        length = lengths.__getitem__
        special = regex.compile("|".join(map(regex.escape, encoder.added)) or r"(?!)")

        def tokens(text: str) -> int:
            total = 0
            for i, part in enumerate(special.split(text)):
                total += (i > 0) + sum(map(length, _SPLIT.findall(part)))
            return total

        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            n_tokens = np.fromiter(map(tokens, texts), np.int64, len(texts))
            n_bytes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
