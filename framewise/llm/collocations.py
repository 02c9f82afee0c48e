"""Phrase collocation mining by best-first growth of prefixes.

A phrase of two or three words scores ``floor(10^6 a^2 / (l r))`` for its counts ``a`` and the counts ``l`` and ``r`` of its parts, at
the cut that scores least. Phrases grow from their prefixes, and a prefix's count bounds what can grow from it: all phrases
behind a word may score 10^6, so all words of at least ``min_count`` are expanded first; a phrase ``w1 w2 w3`` scores at most
``floor(10^6 f(w1 w2) / f(w1))``. The frontier of pairs is expanded from the highest bound down: each round takes, for every
language that is not settled, the pairs whose bound reaches the score of a certain rank among pairs (``2 top``, then four times
as many), counts what grows from them, and also what ends in a pair that scores so high, as a longer phrase may cover it. A
language is settled once ``top`` surviving phrases score at least that much: what is left in its frontier scores less, so its
ranks, ties included, can no longer change.

Every count is a map-side count per slice of text and a combined sum. What need not be counted is kept from the shuffle by
one-hash filters of at most ``FILTER_BITS`` bits (16 MB), whatever the number of words; a false hit is a phrase more to be
counted, in full, and never a wrong count. Languages and frequent words are looked up with hot keys apart, and thresholds come
from counts per score, of which there are at most a million and one. Sums of products are exact decimals.

Defined cases: a null language is ``und``; a null or empty text has no words; repeated rows count again; very long texts are read in
slices at blanks; ties share a score and are ranked by count, then by the bytes of the phrase; languages without a candidate
and empty tables give no rows. Only ``text`` and ``lang`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import look_up, small_batches, text_or_empty, write_table
from framewise.operators.ordered import first_k

TOP = 2000
MIN_COUNT = 10
COVER_PERCENT = 50
SCALE = 1_000_000
FILTER_BITS = 1 << 27
#: Bytes of text counted together, and bytes of words a worker remembers.
SLICE = 1 << 20
FLUSH_BYTES = 8 << 20
WORD_BYTES = 32 << 20
SEED = 42

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
#: A byte that UTF-8 never holds stands for the end of a piece.
_END = b"\xff"
COUNTED = "lang string, phrase string, n long"


def slices(text: str) -> Iterator[tuple[bytes, bool]]:
    """The text in lower case with one byte for each kind of break, in slices cut at breaks; and whether a piece goes on into the next slice."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while len(raw) - at > SLICE:
        cut = max(raw.rfind(b" ", at, at + SLICE), raw.rfind(b"\n", at, at + SLICE))
        if cut < 0:
            later = [x for x in (raw.find(b" ", at + SLICE), raw.find(b"\n", at + SLICE)) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield raw[at : cut + 1], raw[cut : cut + 1] == b" "
        at = cut + 1
    yield raw[at:], False


def _rows(lang: str, phrases: pa.Array, counts) -> pa.RecordBatch:
    counts = pa.array(counts, pa.int64())
    langs = pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int64)))
    return pa.RecordBatch.from_arrays([langs, phrases, counts], ["lang", "phrase", "n"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and a row without a word for all words of the language."""
    counts: dict[str, Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            yield _rows(lang, pa.array([*words], pa.binary()).cast(pa.string()), [*words.values()])
            yield _rows(lang, pa.array([None], pa.string()), [sum(words.values())])
        counts.clear()

    for batch in small_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for raw, _ in slices(text):
                counts.setdefault(lang, Counter()).update(raw.split())
                size += len(raw)
            if size > 2 * FLUSH_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` gives for two 64-bit columns, for arrays of them."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )

    def rotated(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    out = np.full(len(left), SEED, np.uint64)
    for value in (left, right):
        out = (out + (p5 + np.uint64(8))) ^ (rotated(value * p2, 31) * p1)
        out = rotated(out, 27) * p1 + p4
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        out = out ^ (out >> np.uint64(32))
    return out


class Filter:
    """Which hashes may be in a set: one bit for each, in at most ``FILTER_BITS`` bits."""

    def __init__(self, keys: DataFrame):
        """``keys`` holds the hashes in ``h``; the driver gets the bits, 4 KB for each group of 32768 that is not empty."""
        n = keys.count()
        bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))
        place = F.pmod("h", F.lit(bits)) + 1
        marks = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits // 8, np.uint8)
        for row in marks.collect():
            self.bits[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bitmap, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Codes(dict):
    """Numbers of a language's words that the filter lets pass; 0 for all others and for the end of a piece."""

    def __init__(self, lang: str, words: Filter):
        super().__init__({_END: 0})
        self.prefix = lang.encode("utf-8", "surrogatepass") + b"\0"
        self.words, self.names, self.hashes, self.bytes = words, [b""], [0], 0
        self.mask, self.bits = int(words.mask), words.bits

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.prefix + word, SEED)
        at = h & self.mask
        code = 0
        if self.bits[at >> 3] >> (at & 7) & 1:
            code = len(self.names)
            self.names.append(word)
            self.hashes.append(h)
        self[word] = code
        self.bytes += len(word) + 100
        return code


def _code_runs(batches: Iterator[pa.RecordBatch], words: Filter, length: int) -> Iterator[tuple[str, _Codes, np.ndarray]]:
    """Codes of consecutive words, language by language, some megabytes of text at once; 0 parts what must not be joined.

    A piece of more than that is cut; its next part begins with the last ``length - 1`` words again, so that no phrase of ``length`` words
    is lost or counted twice.
    """
    states: dict[str, tuple[_Codes, list]] = {}
    size = 0

    def flush(cut: str | None = None) -> Iterator[tuple]:
        for lang, (codes, parts) in states.items():
            if parts:
                whole = np.concatenate(parts)
                parts[:] = [whole[1 - length :]] if lang == cut else []
                yield lang, codes, whole
        if cut is None and sum(c.bytes for c, _ in states.values()) > WORD_BYTES:
            states.clear()

    for batch in small_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for raw, goes_on in slices(text):
                if lang not in states:
                    states[lang] = (_Codes(lang, words), [])
                codes, parts = states[lang]
                tokens = raw.replace(b"\n", b" \xff ").split()
                if not goes_on:
                    tokens.append(_END)
                parts.append(np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens)))
                size += len(raw)
                if size > FLUSH_BYTES:
                    yield from flush(lang if goes_on else None)
                    size = 0
    yield from flush()


def _phrases(codes: _Codes, *columns: np.ndarray) -> pa.Array:
    names = pa.array(codes.names, pa.binary())
    return pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in columns], b" ").cast(pa.string())


def _count_pairs(batches: Iterator[pa.RecordBatch], words: Filter) -> Iterator[pa.RecordBatch]:
    for lang, codes, x in _code_runs(batches, words, 2):
        left, right = x[:-1], x[1:]
        both = (left > 0) & (right > 0)
        pairs, n = np.unique(left[both] << 32 | right[both], return_counts=True)
        yield _rows(lang, _phrases(codes, pairs >> 32, pairs & 0xFFFFFFFF), n)


def _count_triples(batches: Iterator[pa.RecordBatch], words: Filter, pairs: Filter, prefixes: Filter, suffixes: Filter) -> Iterator[pa.RecordBatch]:
    """Triples of two frequent pairs whose first is expanded in this round, or whose last may be covered."""
    for lang, codes, x in _code_runs(batches, words, 3):
        hashes = np.array(codes.hashes, np.uint64)[x]
        h = pair_hash(hashes[:-1], hashes[1:])
        frequent = (x[:-1] > 0) & (x[1:] > 0) & pairs.has(h)
        at = np.flatnonzero(frequent[:-1] & frequent[1:])
        at = at[prefixes.has(h[at]) | suffixes.has(h[at + 1])]
        if not len(at):
            continue
        first, n = np.unique(np.stack([x[at] << 32 | x[at + 1], x[at + 2]], 1), axis=0, return_counts=True)
        yield _rows(lang, _phrases(codes, first[:, 0] >> 32, first[:, 0] & 0xFFFFFFFF, first[:, 1]), n)


def _counted(texts: DataFrame, run, min_count: int, *filters: Filter) -> DataFrame:
    """``lang``, ``phrase`` and ``n`` of what ``run`` counts, from ``min_count`` on; a null phrase always."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)
    counts = texts.mapInArrow(lambda batches: run(batches, *shared.value), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return write_table(counts.where((F.col("n") >= min_count) | F.col("phrase").isNull()))[0]


def _word_hash(word: Column | str) -> Column:
    return F.xxhash64(F.concat(F.col("lang"), F.lit("\0"), F.col(word) if isinstance(word, str) else word))


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(10^6 a^2 / (l r))``, exact for counts below 10^15."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), left * right)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _pairs(counted: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with their parts' counts, the score, the bound of what grows from them, and their hash."""
    for name in ("w1", "w2"):
        counted = counted.withColumn(name, F.split_part("phrase", F.lit(" "), F.lit(int(name[1]))))
    for name, count in (("w1", "l"), ("w2", "r")):
        side = words.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
        counted, _ = write_table(look_up(counted, side, ["lang", name]))
    bound = _div((F.col("n") * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)"), F.col("l").cast("decimal(20,0)"))
    return write_table(counted.select(
        "lang", "phrase", F.col("n").alias("a"), "l", "r", score(F.col("n"), F.col("l"), F.col("r")).alias("score"), bound.alias("bound"),
        F.xxhash64(_word_hash("w1"), _word_hash("w2")).alias("h"),
    ))[0]


def _triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with the counts at the cut that scores least, and the counts of the pairs at both ends."""
    words = F.split("phrase", " ")
    df = counted.select(
        "lang", "phrase", F.col("n").alias("a"), F.array_join(F.slice(words, 1, 2), " ").alias("head"), F.array_join(F.slice(words, 2, 2), " ").alias("tail")
    )
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_head"), F.col("l").alias("f_first"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_tail"), F.col("r").alias("f_last"))
    df, _ = write_table(look_up(write_table(df)[0], head, ["lang", "head"]))
    df = look_up(df, tail, ["lang", "tail"])
    one, two = score(F.col("a"), F.col("f_first"), F.col("f_tail")), score(F.col("a"), F.col("f_head"), F.col("f_last"))
    df = df.withColumn("one", one).withColumn("two", two)
    early = F.col("one") <= F.col("two")
    return df.select(
        "lang", "phrase", "a", "head", "tail", "f_head", "f_tail", F.when(early, F.col("f_first")).otherwise(F.col("f_head")).alias("l"),
        F.when(early, F.col("f_tail")).otherwise(F.col("f_last")).alias("r"), F.least("one", "two").alias("score"),
    )


def _thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """For each language the score of the pair of that rank; -1 if it has fewer pairs. Scores are few, so their counts are too."""
    counts = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("score").desc()))
    reached = counts.withColumn("upto", upto).groupBy("lang")
    return reached.agg(F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(-1)).alias("least"))


def collocations(
    docs: DataFrame, *, top: int = TOP, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, first_rank: int | None = None
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language) and ``score``.

    A candidate inside a longer one that has at least ``cover_percent`` of its count is left out.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    counted = _counted(texts, count_words, min_count)
    words = counted.where("phrase IS NOT NULL")
    totals = counted.where("phrase IS NULL").select("lang", "n")
    word_filter = Filter(words.select(_word_hash("phrase").alias("h")))
    pairs = _pairs(_counted(texts, _count_pairs, min_count, word_filter), words)
    pair_filter = Filter(pairs.select("h"))
    open_pairs, triples, settled, rank = pairs, None, [], first_rank or 2 * top
    while not open_pairs.isEmpty():
        leveled, _ = write_table(look_up(open_pairs, write_table(_thresholds(open_pairs, rank))[0], ["lang"]))
        frontier = [Filter(leveled.where(F.col(c) >= F.col("least")).select("h")) for c in ("bound", "score")]
        grown, _ = write_table(_triples(_counted(texts, _count_triples, min_count, word_filter, pair_filter, *frontier), pairs))
        triples = grown if triples is None else write_table(triples.union(grown).dropDuplicates(["lang", "phrase"]))[0]
        covered = [
            triples.where(100 * F.col("a") >= cover_percent * F.col(f"f_{end}")).select("lang", F.col(end).alias("phrase")) for end in ("head", "tail")
        ]
        high = leveled.where("score >= least").join(covered[0].union(covered[1]).distinct(), ["lang", "phrase"], "left_anti")
        levels = leveled.groupBy("lang").agg(F.first("least").alias("least"))
        longer = look_up(triples, levels, ["lang"]).where("score >= least")
        shape = ["lang", "phrase", "a", "l", "r", "score", "least"]
        found, _ = write_table(high.select(shape).union(longer.select(shape)))
        ready = levels.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("found")), "lang", "left")
        ready, _ = write_table(ready.where((F.col("found") >= top) | (F.col("least") < 0)).select("lang"))
        settled.append(look_up(found, ready, ["lang"]).select(shape[:-1]))
        open_pairs, _ = write_table(leveled.join(F.broadcast(ready) if ready.count() <= 10_000 else ready, "lang", "left_anti").drop("least"))
        rank *= 4
    if not settled:
        empty = pairs.select("lang", "phrase", "a", "l", "r", "score").where("false")
        settled = [empty]
    best = settled[0]
    for more in settled[1:]:
        best = best.union(more)
    ranked = first_k(best, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    out = look_up(write_table(ranked)[0], totals, ["lang"])
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
