"""Repeated passages through a sparse suffix array.

A text is a sequence of words. In every run of ``REACH`` positions the one whose next ``SEED_WORDS`` words hash lowest is
retained, so texts that share a passage of ``MIN_WORDS`` words retain a position of it at the same place. The suffixes at
retained positions are sorted by their first ``HEAD`` words over the whole corpus, and each is compared with its
neighbours. Suffixes whose head is like a neighbour's are extended: to the right, to ``MIN_WORDS`` words from the suffix; to
the left, by starting up to ``REACH`` - 1 words earlier. Each start whose ``MIN_WORDS`` words are found in another document
too is part of a repeated passage, and overlapping ones are joined. The result is exact: a word is reported if and only if
a run of ``MIN_WORDS`` words around it is in two documents.

Starts between two retained positions are left out where all suffixes of the heads around agree so far to the left and
right that every text that shares a run starting there also shares the runs at both positions, which cover it.

The sort is by range, with the document in the key, so a passage that a third of all documents share is cut into ranges.
Words are compared by two independent 64-bit hashes of the run.

Defined cases: a null text counts as empty; texts under ``MIN_WORDS`` words have no passage; rows with equal id and equal
text count as one document, as do repeats inside one document; of several occurrences the one with the least ``doc_id``
(null first), then the earliest, is the kept one; an empty table gives an empty table. ``passages`` reads only ``doc_id``
and ``text``; ``cut_repeats`` carries all columns in one struct, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import keyed_texts, remove_table, small_batches, text_or_empty, write_table

MIN_WORDS = 50
REACH = 30
SEED_WORDS = 8
HEAD = MIN_WORDS - REACH + 1
CACHE_WORDS = 200_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self, multiplier: int):
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            ones = np.ones(size, np.uint64)
            self.up, self.down = ones.copy(), ones.copy()
            self.up[1:], self.down[1:] = np.uint64(self.multiplier), np.uint64(self.inverse)
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        return self.up[:n], self.down[:n]


_powers = [_Powers(m) for m in _MULTIPLIERS]


class RunHashes:
    """Hashes of any run of words of a text from running sums."""

    def __init__(self, words: list[bytes]):
        base = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        self.n = len(words)
        self.sums, self.down = [], []
        for k, powers in enumerate(_powers):
            up, down = powers.upto(self.n + 1)
            own = base if k == 0 else (base ^ (base >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: self.n], dtype=np.uint64)]))
            self.down.append(down)

    def at(self, starts: np.ndarray, length: int | np.ndarray, which: int = 0) -> np.ndarray:
        x = (self.sums[which][starts + length] - self.sums[which][starts]) * self.down[which][starts]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def lowest_seeds(runs: RunHashes) -> np.ndarray:
    """For each start of ``MIN_WORDS`` words: the position among the first ``REACH`` whose seed hashes lowest.

    It depends on the words of that run alone, so whoever shares the run has it too. These positions are the retained ones.
    """
    last = runs.n - MIN_WORDS + REACH
    seeds = runs.at(np.arange(last), SEED_WORDS)
    lowest = np.lib.stride_tricks.sliding_window_view(seeds, REACH).argmin(axis=1)
    return lowest + np.arange(len(lowest))


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass"))


def _doc_key(doc_id: Column, text: Column) -> Column:
    """One document: equal id and equal text."""
    return F.xxhash64(doc_id, text)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes: ``left`` is the run from the position before to the head's end, ``right`` the one to the end of
    ``MIN_WORDS`` words at the position after; 0 where there is none."""
    for batch in small_batches(batches):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            if len(words) < MIN_WORDS:
                continue
            runs = RunHashes(words)
            at = np.unique(lowest_seeds(runs))
            left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            gap = at[1:] - at[:-1]
            left[1:] = runs.at(at[:-1], gap + HEAD)
            whole = np.flatnonzero(at[1:] + MIN_WORDS <= runs.n)
            right[whole] = runs.at(at[whole], gap[whole] + MIN_WORDS)
            columns = (runs.at(at, HEAD).view(np.int64), left.view(np.int64), right.view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32))
            for column, values in zip(out, columns):
                column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["head", "left", "right", "doc", "place"])
    _hashes.clear()


def _like_neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose head is a neighbour's too, and whether all suffixes of the head agree on ``left`` and on ``right``.

    The first and the last head of a batch may go on in another one: their rows pass, and count as not agreeing.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        head, left, right = (batch.column(c).to_numpy() for c in ("head", "left", "right"))
        edge = (head == head[0]) | (head == head[-1])
        cut = np.ones(len(head), bool)
        cut[1:] = head[1:] != head[:-1]
        starts, run = np.flatnonzero(cut), np.cumsum(cut) - 1
        passed = edge | (np.diff(np.append(starts, len(head))) > 1)[run]
        agree = [(np.minimum.reduceat(v, starts) == np.maximum.reduceat(v, starts))[run] & (v != 0) & ~edge for v in (left, right)]
        kept = [batch.column(c).to_numpy()[passed] for c in ("doc", "place")] + [v[passed] for v in agree]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in kept], ["doc", "place", "same_left", "same_right"])


def extended_starts(lowest: np.ndarray, places: np.ndarray, same_left: np.ndarray, same_right: np.ndarray) -> np.ndarray:
    """Starts of runs of ``MIN_WORDS`` words to compare: those whose lowest seed has a head found elsewhere.

    Left out is a start after a retained position p if all heads from the next one to the lowest seed agree on their left,
    which leads whoever shares the run back to p, and p agrees on its right, which gives both runs that cover it.
    """
    at = np.unique(lowest)
    found = np.searchsorted(at, places)
    alive, left, right = np.zeros(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), bool)
    alive[found], left[found], right[found] = True, same_left, same_right
    starts = np.arange(len(lowest))
    seed, before = np.searchsorted(at, lowest), np.searchsorted(at, starts, side="right") - 1
    loose = np.concatenate([[0], np.cumsum(~left)])
    led_back = loose[seed + 1] == loose[before + 1]
    covered = (before >= 0) & (at[before] != starts) & led_back & right[before]
    return starts[alive[seed] & ~covered]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["run_a", "run_b", "doc", "doc_id", "start"]
    for batch in small_batches(batches, 256):
        out: list[list[np.ndarray]] = [[], [], [], []]
        ids: list = []
        columns = [batch.column(c).to_pylist() for c in ("doc", "doc_id", "text", "found")]
        for doc, doc_id, text, found in zip(*columns):
            runs = RunHashes(words_of(text))
            places = np.array([f["place"] for f in found])
            order = np.argsort(places)
            agree = [np.array([f[c] for f in found])[order] for c in ("same_left", "same_right")]
            starts = extended_starts(lowest_seeds(runs), places[order], *agree)
            for column, values in zip(
                out, (runs.at(starts, MIN_WORDS, 0), runs.at(starts, MIN_WORDS, 1), np.full(len(starts), doc), starts.astype(np.int32))
            ):
                column.append(values)
            ids.extend([doc_id] * len(starts))
        if ids:
            a, b, doc, start = (np.concatenate(c) for c in out)
            arrays = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(ids, pa.int64()), pa.array(start)]
            yield pa.RecordBatch.from_arrays(arrays, names)
    _hashes.clear()


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, str]:
    """Runs of ``MIN_WORDS`` words that are in two documents or more, as a written table and its path.

    Columns: ``doc`` (key of the document), ``doc_id``, ``start`` (word), ``source_id`` (document of the kept
    occurrence) and ``kept``.
    """
    spark = docs.sparkSession
    keyed = keyed_texts(docs).withColumn("doc", _doc_key(F.col("doc_id"), F.col("text")))
    suffixes, suffix_path = write_table(
        keyed.select("doc", "text").mapInArrow(_suffixes, "head long, left long, right long, doc long, place int")
    )
    in_order = suffixes.repartitionByRange("head", "doc", "place").sortWithinPartitions("head", "doc", "place")
    found = in_order.mapInArrow(_like_neighbour, "doc long, place int, same_left boolean, same_right boolean")
    # Rows with equal id and text retain the same places; where they disagree on an edge, the cautious flags hold.
    found = found.groupBy("doc", "place").agg(F.min("same_left").alias("same_left"), F.min("same_right").alias("same_right"))
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("place", "same_left", "same_right")).alias("found"))
    texts = keyed.join(by_doc, "doc").select("doc", "doc_id", "text", "found")
    runs, run_path = write_table(texts.mapInArrow(_extended, "run_a long, run_b long, doc long, doc_id long, start int"))
    remove_table(spark, suffix_path)
    first = F.min(F.struct("doc_id", "doc", "start")).alias("first")
    shared = runs.groupBy("run_a", "run_b").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), first)
    # Written first: the join then deals both sides itself, and can split a run that very many documents share.
    shared, shared_path = write_table(shared.where(F.col("low") != F.col("high")).select("run_a", "run_b", "first"))
    kept = (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))
    flagged = runs.join(shared, ["run_a", "run_b"]).select(
        "doc", "doc_id", "start", F.col("first.doc_id").alias("source_id"), kept.alias("kept")
    )
    result, path = write_table(flagged)
    remove_table(spark, run_path)
    remove_table(spark, shared_path)
    return result, path


def _spans(runs: DataFrame) -> DataFrame:
    """Per document and ``kept``: its joined spans, with the text's key."""
    listed = runs.groupBy("doc", "doc_id", "kept").agg(F.sort_array(F.collect_set(F.struct("start", "source_id"))).alias("runs"))

    @F.arrow_udf("array<struct<first:int,until:int,source:bigint>>")
    def spans(column: pa.Array) -> pa.Array:
        out = []
        for runs in column.to_pylist():
            joined: list[dict] = []
            for r in runs:
                if joined and r["start"] <= joined[-1]["until"]:
                    joined[-1]["until"] = r["start"] + MIN_WORDS
                else:
                    joined.append({"first": r["start"], "until": r["start"] + MIN_WORDS, "source": r["source_id"]})
            out.append(joined)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("until", pa.int32()), ("source", pa.int64())])))

    return listed.select("doc", "doc_id", "kept", spans("runs").alias("spans"))


def passages(docs: DataFrame) -> DataFrame:
    """One row per document and repeated span: ``doc_id``, ``first_word``, ``until_word``, ``source_id``, ``kept``.

    ``kept`` marks spans of first occurrences; the others repeat them, and ``source_id`` names the document that keeps
    the words at the span's start.
    """
    runs, _ = repeated_runs(docs)
    exploded = _spans(runs).select("doc_id", "kept", F.explode("spans").alias("s"))
    return exploded.select("doc_id", F.col("s.first").alias("first_word"), F.col("s.until").alias("until_word"), F.col("s.source").alias("source_id"), "kept")


def _cut(text: str, spans: list[dict]) -> str:
    """A text without the words of the spans and the white space after each span."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["first"]):
        out.append(raw[at : ends[s["first"]][0]])
        at = ends[s["until"]][0] if s["until"] < len(ends) else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated spans, save the kept occurrence of each; rows left without a word are dropped.

    Rows without a repeated span stay as they are, wordless ones too.
    """
    runs, _ = repeated_runs(docs)
    spans = _spans(runs.where(~F.col("kept"))).select(F.col("doc").alias("cut_doc"), "spans")

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut(t, s) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    packed = docs.select(
        F.struct("*").alias("row"), text_or_empty().alias("text"), _doc_key(F.col("doc_id").cast("long"), text_or_empty()).alias("doc")
    )
    # Not deterministic, so that the filter below is not pushed into it: each text would be cut twice, by two workers of a task.
    cut = without.asNondeterministic()(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))
    joined = packed.join(spans, packed.doc == spans.cut_doc, "left").select("row", "spans", cut.alias("new_text"))
    left = joined.where(F.col("spans").isNull() | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("new_text"))
    return left.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
