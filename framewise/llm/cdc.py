"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text. Chunk ends are chosen by its bits, with a strict mask before the
normal size and a loose one after it, so sizes gather around the normal one and an edit moves only the chunks it
touches. A fingerprint is the sorted set of chunk digests, each with its length; the containment of one set in another,
weighted by length, tells how much of one text is found in the other. Texts of up to ``SHORT`` characters, of which such
chunks show little, carry the chunks of a second, finer level too, and two of them are compared by the level that shows more.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, which is like another empty one (1)
and unlike any other (0); equal texts have equal fingerprints. Rows follow each other by ``doc_id``, null first, and
then by text; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import keyed_texts, small_batches

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 48, 240
STRICT_BITS, LOOSE_BITS = 7, 4
DIGEST_BYTES = 6
#: Characters up to which a text has fine chunks, which follow the bits of the last ``FINE_WINDOW`` bytes alone.
SHORT, FINE_WINDOW = 400, 4
FINE_MIN, FINE_MAX, FINE_BITS = 3, 12, 1
#: Hexadecimal digits of one entry: the digest and one byte of length; that of a fine chunk is above ``MAX_SIZE``.
ENTRY = 2 * DIGEST_BYTES + 2
#: Bytes of text that one range of neighbouring documents should hold.
RANGE_BYTES = 4 << 20
#: Most ranges; it bounds the constant array of cuts. A range is streamed, so a longer one needs no more memory.
MAX_RANGES = 16384
SLICE = 1 << 16


def _gear_table() -> np.ndarray:
    """One pseudo-random 32-bit number for each byte value, from a fixed multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 32 table values, each doubled once per step; by doubling windows."""
    h = GEAR[data]
    width = 1
    while width < 32:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a byte string, the last one at its length."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    loose_shift, strict_shift = np.uint32(32 - LOOSE_BITS), np.uint32(32 - STRICT_BITS)
    at: list[int] = []
    strict: list[bool] = []
    for low in range(0, n, SLICE):  # a slice takes the 31 bytes before it along
        back = min(low, 31)
        h = gear_hashes(raw[low - back : low + SLICE])[back:]
        hits = np.flatnonzero((h >> loose_shift) == 0)
        at.extend((hits + (low + 1)).tolist())
        strict.extend(((h[hits] >> strict_shift) == 0).tolist())
    ends: list[int] = []
    start = 0
    for end, is_strict in zip(at, strict):
        size = end - start
        if size < MIN_SIZE:
            continue
        while size > MAX_SIZE:
            start += MAX_SIZE
            ends.append(start)
            size = end - start
        if size >= MIN_SIZE and (is_strict or size >= NORMAL_SIZE):
            ends.append(end)
            start = end
    while n - start > MAX_SIZE:
        start += MAX_SIZE
        ends.append(start)
    if n > start:
        ends.append(n)
    return ends


def fine_ends(data: bytes) -> list[int]:
    """Ends of the fine chunks of a short byte string."""
    h = gear_hashes(np.frombuffer(data, np.uint8))
    hits = ((h >> np.uint32(FINE_WINDOW - FINE_BITS)) & np.uint32((1 << FINE_BITS) - 1)) == 0
    ends, start = [], 0
    for end, hit in enumerate(hits.tolist(), 1):
        if end - start >= FINE_MIN and (hit or end - start == FINE_MAX):
            ends.append(end)
            start = end
    return ends if start == len(data) else [*ends, len(data)]


def _is_short(data: bytes) -> bool:
    return len(data) <= 4 * SHORT and sum(b & 0xC0 != 0x80 for b in data) <= SHORT


def chunk_digests(data: bytes) -> dict[bytes, int]:
    """Digest of each different chunk with its length, and for a fine one with ``MAX_SIZE`` more."""
    out: dict[bytes, int] = {}
    if _is_short(data):
        start = 0
        for end in fine_ends(data):
            out[hashlib.blake2b(data[start:end], digest_size=DIGEST_BYTES, person=b"fine").digest()] = MAX_SIZE + end - start
            start = end
    start = 0
    for end in chunk_ends(data):
        out[hashlib.blake2b(data[start:end], digest_size=DIGEST_BYTES).digest()] = end - start
        start = end
    return out


def encode(chunks: dict[bytes, int]) -> str:
    return b"".join([d + n.to_bytes(1) for d, n in sorted(chunks.items())]).hex()


def decode(fingerprint: str) -> dict[bytes, int]:
    raw = bytes.fromhex(fingerprint)
    step = DIGEST_BYTES + 1
    return {raw[i : i + DIGEST_BYTES]: raw[i + DIGEST_BYTES] for i in range(0, len(raw), step)}


def containment(inner: dict[bytes, int], outer: dict[bytes, int]) -> float:
    """Share of the length of ``inner``'s chunks that ``outer`` has too; of two levels that both have, the larger share."""
    if not inner:
        return 0.0 if outer else 1.0
    coarse = {d: n for d, n in inner.items() if n <= MAX_SIZE}
    fine = {d: n - MAX_SIZE for d, n in inner.items() if n > MAX_SIZE}
    levels = [coarse, fine] if fine and any(n > MAX_SIZE for n in outer.values()) else [coarse]
    return max(sum(n for d, n in level.items() if d in outer) / sum(level.values()) for level in levels)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row, without any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [encode(chunk_digests(t.encode("utf-8", "surrogatepass"))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.string())], ["doc_id", "fingerprint"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``other``, or all of them."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _pairs(with_text: bool):
    schema = OUT if with_text else pa.schema([f for f in OUT if f.name != "edited_text"])

    def row(doc_id, text, chunks, next_text, next_chunks):
        new = edited(text, next_text)
        raw = new.encode("utf-8", "surrogatepass")
        new_chunks = chunk_digests(raw)
        out = {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": encode(chunks),
            "edited_fingerprint": encode(new_chunks), "near_edited": containment(chunks, new_chunks),
            "near_next": containment(chunks, next_chunks),
        }
        return out | {"edited_text": new} if with_text else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, chunks) of the row before
        for batch in small_batches(batches):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("rng", "guest", "doc_id", "text")]
            for rng, guest, doc_id, text in zip(*columns):
                chunks = chunk_digests(text.encode("utf-8", "surrogatepass"))
                if held is not None and held[0] == rng:
                    rows.append(row(*held[1:], text, chunks))
                held = None if guest else (rng, doc_id, text, chunks)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run, schema


def edited_pairs(docs: DataFrame, *, range_bytes: int = RANGE_BYTES, with_text: bool = False) -> DataFrame:
    """Each row against its edited text and against the next row by ``doc_id``; the last row is followed by the first.

    Rows are dealt to ranges of neighbouring ids by quantiles of the ids alone, and the first row of each range goes to
    the range before too, as a guest. So a text crosses the network once, and no window spans the whole table.
    """
    df = keyed_texts(docs)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    sizes = df.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n_ranges = max(1, min(MAX_RANGES, int(sizes["rows"]), -(-int(sizes["bytes"] or 0) // range_bytes)))
    ids = df.select(key.cast("double").alias("k"))
    cuts = sorted(set(ids.approxQuantile("k", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges))) if n_ranges > 1 else []
    ranged = df.withColumn("k", key).withColumn("rng", _range_of(key.cast("double"), cuts))
    # One row for each range: ids only, no text.
    firsts = ranged.groupBy("rng").agg(F.min("k").alias("first_k"))
    around = Window.partitionBy(F.lit(0)).orderBy("rng")
    before = F.coalesce(F.lag("rng").over(around), F.max("rng").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select(F.col("rng").alias("host"), "first_k", before.alias("to"))
    tagged = ranged.join(F.broadcast(firsts), (F.col("rng") == F.col("host")) & (F.col("k") == F.col("first_k")), "left")
    own = F.struct("rng", F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("rng"), F.lit(True).alias("guest"))
    placed = tagged.select("doc_id", "k", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("p"))
    placed = placed.select("p.rng", "p.guest", "k", "doc_id", "text")
    run, schema = _pairs(with_text)
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    spread = placed.repartition("rng").sortWithinPartitions("rng", "guest", "k", "text")
    return spread.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _range_of(key, cuts: list[float]):
    """How many cuts are at or below the key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit("[" + ",".join(map(repr, cuts)) + "]"), "array<double>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda at, jump: F.when((at + jump <= len(cuts)) & (F.get(table, at + jump - 1) <= key), at + jump).otherwise(at)
    )
