"""Packing by power-of-two decomposition.

The ids of a document, and the closing id, are cut into pieces whose lengths are powers of two: full pieces of the
window first, then the binary digits of the rest, largest first. A piece is a sequence of its own, of its own length, so
no sequence crosses documents and none needs padding. Sequences of one length form a bucket.

Defined cases: a null or empty text gives one piece with the closing id; equal rows are packed separately; an empty
table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns never clash.

``sequence_id`` is the partition of the input and a running number in it. It is the same when a lost task is computed
again, as long as the input's partitions are, which holds for files; no exchange is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from framewise.llm.bpe_ids import read_vocabulary, worker_encoder
from framewise.llm.common import keyed_texts, small_batches

WINDOW = 2048
CLOSING_ID = 1
PARTITION_STEP = 1 << 40


def cut_lengths(n: int, window: int = WINDOW) -> list[int]:
    """``n`` as full windows and then falling powers of two."""
    full, rest = divmod(n, window)
    return [window] * full + [1 << k for k in range(window.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary_path: str, *, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length`` (its bucket), ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    closing = np.array([closing_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(shared.value).encode
        number = TaskContext.get().partitionId() * PARTITION_STEP
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + closing
                total, start = len(ids) // 4, 0
                for length in cut_lengths(total, window):
                    for column, value in zip(out, (doc_id, start, length, total, ids[4 * start : 4 * (start + length)])):
                        column.append(value)
                    start += length
            n = len(out[0])
            columns = [pa.array(c, pa.int64()) for c in out[:4]]
            columns += [pa.array(np.arange(number, number + n)), pa.array(np.zeros(n, np.int64)), pa.array(out[4], pa.binary())]
            number += n
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed_texts(docs).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length, so that a training batch holds equal lengths."""
    pieces.write.partitionBy("length").parquet(path)
