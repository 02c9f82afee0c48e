"""Quality scores from a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes slide over the whole document two bytes at a time, and each filter's largest
response is taken in overlapping chunks of 256 bytes. A small layer turns a chunk's responses into features; their mean
over all chunks gives the document's probability of quality 1.

Training uses a bounded sample: of each label the ``PER_CLASS`` ids with the least hashes, or all if there are fewer, and
never a row whose crc32(``doc_id`` as text) leaves 1 when divided by 3. One text stands for an id, and of one with over
``CUT_CHUNKS`` chunks so many are cut out at random places on the executors, so the driver gets at most 2 * ``PER_CLASS``
rows of 32 KiB. Scoring reads every byte of every text.

Defined cases: a null or empty text is scored as one chunk of padding; without labels of both classes every score is the
smoothed share of label 1 (0.5 without any); repeated rows get equal scores; an empty table gives an empty table.
``score`` reads only ``doc_id`` and ``text``; ``keep_good`` carries all columns in one struct, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import keyed_texts, small_batches, text_or_empty

PER_CLASS = 1000
CHUNK, STEP = 256, 128
WIDTH, STRIDE, DEPTH, FILTERS, HIDDEN = 8, 2, 6, 24, 12
EPOCHS, DOCS_PER_BATCH, CHUNKS_PER_DOC, RATE, SHORT_SHARE = 14, 32, 8, 0.01, 0.2
SLICE = 1 << 16
#: Chunks that stand for a longer text in training, which looks at ``EPOCHS`` * ``CHUNKS_PER_DOC`` of them at most.
CUT_CHUNKS = 128


def _windows(embedded: np.ndarray) -> np.ndarray:
    """(.., bytes, DEPTH) to (.., positions, WIDTH * DEPTH), every second byte."""
    shape, strides = embedded.shape, embedded.strides
    positions = (shape[-2] - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(
        embedded, (*shape[:-2], positions, WIDTH * DEPTH), (*strides[:-2], strides[-2] * STRIDE, strides[-1]), writeable=False
    )


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class ByteCnn:
    """Weights and the forward pass. ``prior`` alone is used when there was nothing to learn from."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "emb": r.normal(0, 0.5, (256, DEPTH)), "conv": r.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)),
            "bias": np.zeros(FILTERS), "mix": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "shift": np.zeros(HIDDEN),
            "out": r.normal(0, HIDDEN**-0.5, HIDDEN), "last": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.prior: float | None = None

    def chunk_responses(self, data: bytes) -> np.ndarray:
        """Largest response of each filter in each chunk; the chunks overlap by half and cover all bytes."""
        w = self.w
        raw = np.frombuffer(data.ljust(CHUNK, b"\0"), np.uint8)
        per_block, per_slice = STEP // STRIDE, SLICE // STRIDE
        total = -(-(len(raw) - WIDTH) // STRIDE) + 1
        blocks = []
        for first in range(0, total, per_slice):
            positions = min(per_slice, total - first)
            padded = np.zeros((positions - 1) * STRIDE + WIDTH, np.uint8)
            part = raw[first * STRIDE : first * STRIDE + len(padded)]
            padded[: len(part)] = part
            windows = _windows(w["emb"][padded])
            out = np.ascontiguousarray(windows) @ w["conv"]
            blocks.append(np.maximum.reduceat(out, np.arange(0, positions, per_block), axis=0))
        block = np.concatenate(blocks)
        chunk = np.maximum(block[:-1], block[1:]) if len(block) > 1 else block
        return np.maximum(chunk + w["bias"], 0)

    def score(self, text: str) -> float:
        if self.prior is not None:
            return self.prior
        w = self.w
        hidden = np.maximum(self.chunk_responses(text.encode("utf-8", "surrogatepass")) @ w["mix"] + w["shift"], 0).mean(axis=0)
        return float(_sigmoid(hidden @ w["out"] + w["last"][0]))

    def step(self, chunks: np.ndarray, owner: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for chunks of bytes; ``owner`` is the document of each chunk."""
        w, docs = self.w, len(target)
        windows = _windows(w["emb"][chunks])
        response = windows.reshape(-1, WIDTH * DEPTH) @ w["conv"]
        response = response.reshape(len(chunks), -1, FILTERS)
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + w["bias"]
        pooled = np.maximum(top, 0)
        before = pooled @ w["mix"] + w["shift"]
        hidden = np.maximum(before, 0)
        share = np.bincount(owner, minlength=docs).astype(np.float32)
        mean = np.zeros((docs, HIDDEN), np.float32)
        np.add.at(mean, owner, hidden / share[owner, None])
        p = _sigmoid(mean @ w["out"] + w["last"][0])
        loss = float(-(weight * np.log(np.where(target == 1, p, 1 - p) + 1e-9)).mean())
        g = weight * (p - target) / docs
        grad = {"out": mean.T @ g, "last": np.array([g.sum()])}
        d_before = np.outer(g, w["out"])[owner] / share[owner, None] * (before > 0)
        grad["mix"], grad["shift"] = pooled.T @ d_before, d_before.sum(0)
        d_top = d_before @ w["mix"].T * (top > 0)
        grad["bias"] = d_top.sum(0)
        rows = np.arange(len(chunks))[:, None]
        picked = windows[rows, best]  # (chunks, filters, WIDTH * DEPTH)
        grad["conv"] = np.einsum("cfx,cf->xf", picked, d_top)
        d_emb = np.zeros_like(w["emb"])
        for j in range(WIDTH):
            byte = chunks[rows, best * STRIDE + j]
            part = w["conv"][j * DEPTH : (j + 1) * DEPTH].T  # (filters, DEPTH)
            np.add.at(d_emb, byte, d_top[:, :, None] * part[None])
        grad["emb"] = d_emb
        return loss, grad


def train(rows: list[tuple[bytes, int]], seed: int = 11, cut: set[int] = frozenset()) -> ByteCnn:
    """Fits a network by Adam on random chunks of each text; classes weigh the same.

    The texts with a position in ``cut`` are separate chunks laid end to end, of which whole ones are taken.
    """
    model = ByteCnn()
    labels = np.array([q for _, q in rows], np.float32)
    if len(rows) == 0 or labels.min() == labels.max():
        model.prior = float((labels.sum() + 1) / (len(rows) + 2))
        return model
    r = np.random.default_rng(seed)
    texts = [np.frombuffer(t.ljust(CHUNK, b"\0"), np.uint8) for t, _ in rows]
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moment = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    turn = 0
    steps = EPOCHS * -(-len(rows) // DOCS_PER_BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(rows))
        for at in range(0, len(order), DOCS_PER_BATCH):
            picked = order[at : at + DOCS_PER_BATCH]
            chunks, owner = [], []
            for k, i in enumerate(picked):
                room = len(texts[i]) - CHUNK
                n = min(CHUNKS_PER_DOC, room // STEP + 1)
                short = r.random() < SHORT_SHARE  # a part of a text is as good as the text, so that short texts are learned too
                for s in r.integers(0, room + 1, 1 if short else n):
                    if i in cut:
                        s = s * (len(texts[i]) // CHUNK) // (room + 1) * CHUNK
                    chunk = texts[i][s : s + CHUNK]
                    if short:
                        chunk = np.where(np.arange(CHUNK) < r.integers(4, CHUNK), chunk, 0).astype(np.uint8)
                    chunks.append(chunk)
                    owner.append(k)
            _, grad = model.step(np.array(chunks), np.array(owner), labels[picked], weight[picked])
            turn += 1
            rate = RATE * (1 - 0.9 * turn / steps)
            for k, g in grad.items():
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                hat = moment[k] / (1 - 0.9**turn) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-7)
                model.w[k] = (model.w[k] - rate * hat).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def excerpt(data: bytes) -> bytes:
    """The bytes themselves, or of more than ``CUT_CHUNKS`` chunks so many from places that depend on the bytes alone."""
    if len(data) <= CUT_CHUNKS * CHUNK:
        return data
    starts = np.random.default_rng(zlib.crc32(data)).integers(0, len(data) - CHUNK + 1, CUT_CHUNKS)
    return b"".join(data[s : s + CHUNK] for s in starts.tolist())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteCnn:
    """Trains on ``per_class`` labelled ids of each class, those with the least hashes, or on all of a smaller class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    ticket = F.xxhash64("doc_id", F.lit("train"))
    drawn = [
        (r.doc_id, r.quality)
        for q in (0, 1)
        for r in usable.where(F.col("quality") == q).distinct().orderBy(ticket, "doc_id").limit(per_class).collect()
    ]
    # At most 2 * per_class rows whatever the size of the table, so the broadcast and what is collected are bounded.
    sample = docs.sparkSession.createDataFrame(drawn, "doc_id long, quality int")

    @F.arrow_udf("binary")
    def excerpts(data: pa.Array) -> pa.Array:
        return pa.array([excerpt(x.as_py()) for x in data], pa.binary())

    found = keyed_texts(docs).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").select(
        "doc_id", F.struct(F.xxhash64("text").alias("h"), (F.octet_length("text") > CUT_CHUNKS * CHUNK).alias("cut"), excerpts(F.col("text").cast("binary")).alias("part")).alias("x")
    )
    one = found.groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = one.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "x.cut", "x.part").collect()
    ordered = sorted((r.doc_id, r.quality, bytes(r.part), r.cut) for r in rows)
    return train([(part, q) for _, q, part, _ in ordered], cut={i for i, row in enumerate(ordered) if row[3]})


def score(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """``doc_id`` and ``score`` for each row, in one pass and without any exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: ByteCnn, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array([model.score(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()], pa.float64())

    packed = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    return packed.where(scored("text") >= threshold).select("row.*")
