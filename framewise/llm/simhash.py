"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Each text gives a 64-bit fingerprint. Distinct fingerprints are filed four times, under each of their 16-bit blocks:
two that differ in at most three bits agree on one block. The rows of a file are sorted by the Gray rank of the rotated
fingerprint, so those with long common bit patterns lie together. Over this order an index of nested nodes is built, in
which a node stands for a bit pattern all its members share. Pairs of nodes are descended from the top: the differences
of their patterns add up, and once they pass the limit the whole pair of groups is dropped. A pair of groups that is
already in one component is dropped too, as it can add nothing to the answer. What leaves a task is one link to a
component's first member for each fingerprint; links of all files meet in distributed connected components.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal texts and repeated rows share a
fingerprint, hence a component; a null ``doc_id`` never names a component unless it is alone in it; an empty table gives
an empty table. Only ``doc_id`` and ``text`` are read, so other columns never clash. A file with over ``HOT_FILE``
members is split under four blocks of the 48 remaining bits, and again while it is too full; links stay for the same reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm import shingles
from framewise.llm.common import keyed_texts, small_batches, text_or_empty
from framewise.llm.components import components
from framewise.session import stage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Members of one file beyond which it is split again. It changes the plan, never the links.
HOT_FILE = 200_000
#: Names of hot files that may be broadcast (8 MB).
HOT_NAMES = 1 << 20
#: Pairs of nodes that are expanded together; bounds memory.
BLOCK = 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of the 3-word shingles of a text."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    hashed = keyed_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _gray_rank(code):
    """Position of a code in the Gray order, as a column expression."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


class GrayIndex:
    """Nested nodes over codes that are sorted by file and then by Gray rank.

    ``levels[k]`` holds the first member of each node at depth k. Depth 0 is the file itself; each further depth adds
    eight bits to the pattern that the members of a node share; at the last depth a node is one code.
    """

    def __init__(self, files: np.ndarray, codes: np.ndarray):
        self.codes = codes
        n = len(codes)
        self.masks = [np.uint64(0)] + [np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF) for k in range(1, 9)]
        new_file = np.ones(n, bool)
        new_file[1:] = files[1:] != files[:-1]
        self.levels = []
        cut = new_file
        for mask in self.masks:
            pattern = codes & mask
            cut = cut.copy()
            cut[1:] |= pattern[1:] != pattern[:-1]
            self.levels.append(np.flatnonzero(cut))
        self.children = [
            np.append(np.searchsorted(self.levels[k + 1], self.levels[k]), len(self.levels[k + 1])) for k in range(len(self.levels) - 1)
        ]
        self.label = np.arange(n)

    def link(self, max_bits: int) -> np.ndarray:
        """Merges codes of a file within ``max_bits`` bits, and returns each code's first member of its component."""
        size = np.diff(np.append(self.levels[0], len(self.codes)))
        roots = np.flatnonzero(size > 1)
        stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
        while stack:
            depth, u, v, gone = stack.pop()
            if len(u) > 1 and depth < len(self.children):
                fan = self._fan(depth, u) * self._fan(depth, v)
                half = int(np.searchsorted(np.cumsum(fan), BLOCK)) + 1
                if half < len(u):
                    stack.append((depth, u[half:], v[half:], gone[half:]))
                    u, v, gone = u[:half], v[:half], gone[:half]
            if depth == len(self.children):
                self._merge(self.levels[depth][u], self.levels[depth][v])
                continue
            keep = ~self._settled(depth, u, v)
            u, v, gone = u[keep], v[keep], gone[keep]
            if len(u):
                for part in self._expand(depth, u, v, gone, max_bits):
                    stack.append(part)
        return self.label

    def _fan(self, depth: int, nodes: np.ndarray) -> np.ndarray:
        first = self.children[depth]
        return first[nodes + 1] - first[nodes]

    def _settled(self, depth: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether all members of both nodes are in one component already."""
        starts = self.levels[depth]
        low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
        return (low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v]) if len(u) else np.zeros(0, bool)

    def _expand(self, depth: int, u, v, gone, max_bits: int):
        """Pairs of children, in pieces of bounded size; the differences of the newly shared bits are added."""
        first, starts = self.children[depth], self.levels[depth + 1]
        mask = self.masks[depth + 1] ^ self.masks[depth]
        fu, fv = self._fan(depth, u), self._fan(depth, v)
        count = fu * fv
        total = np.cumsum(count)
        for low in range(0, int(total[-1]), BLOCK):
            at = np.arange(low, min(low + BLOCK, int(total[-1])))
            pair = np.searchsorted(total, at, side="right")
            inner = at - (total[pair] - count[pair])
            cu = first[u[pair]] + inner // fv[pair]
            cv = first[v[pair]] + inner % fv[pair]
            code_u, code_v = self.codes[starts[cu]], self.codes[starts[cv]]
            now = gone[pair] + _popcount((code_u ^ code_v) & mask)
            ok = (now <= max_bits) & (cu <= cv)
            if depth + 1 == len(self.children):
                ok &= cu != cv
            if ok.any():
                yield depth + 1, cu[ok], cv[ok], now[ok]

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _links_of(files: np.ndarray, turns: np.ndarray, ranks: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    codes = ranks ^ (ranks >> np.uint64(1))
    label = GrayIndex(files, codes).link(max_bits)
    moved = np.flatnonzero(label != np.arange(len(label)))
    turns = turns.astype(np.uint64)

    def back(i: np.ndarray) -> np.ndarray:
        r = turns[i]
        return np.where(r == 0, codes[i], (codes[i] >> r) | (codes[i] << ((np.uint64(64) - r) & np.uint64(63)))).view(np.int64)

    return back(moved), back(label[moved])


def _task_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0

        def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            columns = [table.column(c).to_numpy() for c in ("file", "turn", "rank")]
            a, b = _links_of(columns[0], columns[1], columns[2].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # whole files are solved as soon as enough rows have gathered
            kept.append(batch)
            rows += batch.num_rows
            if rows >= HOT_FILE:
                table = pa.Table.from_batches(kept)
                files = table.column("file").to_numpy()
                cut = len(files) - int(np.argmin(files[::-1] == files[-1])) if files[0] != files[-1] else 0
                if cut:
                    yield solve(table.slice(0, cut).to_batches())
                    kept, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield solve(kept)

    return run


def _split(files: DataFrame, width: int) -> DataFrame:
    """Members of files that agree on all but ``width`` bits (``rest``), filed under each of four blocks of those.

    Two members within three bits agree on one of the four, as they did before.
    """
    size = width // 4

    def under(k: int) -> Column:
        low = width - size * (k + 1)
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low)
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
        return F.struct(F.xxhash64("file", F.lit(k), value).alias("file"), rest.alias("rest"))

    return files.select("turn", "code", F.explode(F.array(*[under(k) for k in range(4)])).alias("x")).select("turn", "code", "x.file", "x.rest")


def _files(fps: DataFrame, hot_file: int) -> DataFrame:
    """``turn``, ``code`` (the fingerprint turned by it) and ``file``: four files for each fingerprint, and four for each again while
    its file holds more than ``hot_file``.

    A file is named by a hash of the blocks its members share; two files of one name would only be compared too. After five
    splits fewer than sixteen bits are left, so a file holds fewer than 65536 different codes and none is hot.
    """
    turned = fps.select(
        F.explode(F.array(*[F.struct(F.lit(16 * k).cast("long").alias("turn"), _rotated(F.col("fp"), 16 * k).alias("code")) for k in range(4)])).alias("x")
    ).select("x.turn", "x.code")
    now = turned.select(
        "turn", "code", F.xxhash64("turn", F.shiftrightunsigned("code", 48)).alias("file"), F.col("code").bitwiseAND(F.lit((1 << 48) - 1)).alias("rest")
    )
    width, done = 48, None
    while True:
        hot = stage(now.groupBy("file").count().where(F.col("count") > hot_file).select("file"))
        n = hot.count() if width >= 8 else 0
        if n:
            hot = F.broadcast(hot) if n <= HOT_NAMES else hot
            cool = now.join(hot, "file", "left_anti")
            now, width = stage(_split(now.join(hot, "file", "left_semi"), width)), width - width // 4
        else:
            cool = now
        cool = cool.select("file", "turn", "code")
        done = cool if done is None else done.unionByName(cool)
        if not n:
            return done


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_file: int = HOT_FILE) -> DataFrame:
    """``a``, ``b``: links whose components are those of all pairs of distinct ``fp`` within ``max_bits`` bits."""
    if max_bits > 3:
        raise ValueError("four blocks prove at most three differing bits")
    placed = _files(fps, hot_file).select("file", "turn", _gray_rank(F.col("code")).alias("rank"))
    spread = placed.repartition(F.col("file")).sortWithinPartitions("file", "rank")
    return spread.mapInArrow(_task_links(max_bits), "a long, b long")


def _grouped(docs: DataFrame, max_bits: int, hot_file: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and the root of each distinct fingerprint; a root is a fingerprint too."""
    fps = stage(fingerprints(docs))
    distinct = stage(fps.select("fp").distinct())
    joined = components(links(distinct, max_bits, hot_file))
    rooted = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return fps, rooted


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, hot_file: int = HOT_FILE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the least ``doc_id`` reachable over links of at most ``max_bits`` bits."""
    fps, rooted = _grouped(docs, max_bits, hot_file)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, hot_file: int = HOT_FILE, similar: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the least ``doc_id``, null ids last.

    Ties between different texts go to the least text hash, and of equal rows one stays. With ``similar``, components are
    also joined by pairs of texts whose 5-word shingles are at least so similar (``shingles.links``).
    """
    fps, rooted = _grouped(docs, max_bits, hot_file)
    if similar is not None:
        rooted = stage(rooted)
        nodes = fps.select(F.col("text_hash").alias("node"), "fp").distinct().join(rooted, "fp").select("node", "root")
        joined = components(shingles.links(docs, stage(nodes), similar)).select(F.col("node").alias("root"), F.col("root").alias("joined"))
        rooted = rooted.join(joined, "root", "left").select("fp", F.coalesce("joined", "root").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = fps.groupBy("fp").agg(F.min(order).alias("best")).join(rooted, "fp")
    chosen = best.groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("best.doc_id").alias("chosen_id"), F.col("best.text_hash").alias("chosen_hash")
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(text_or_empty()).alias("row_hash")
    )
    same = (F.col("row_hash") == F.col("chosen_hash")) & F.col("row_id").eqNullSafe(F.col("chosen_id"))
    kept = rows.join(chosen, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("row_hash", "row_id").orderBy("row_id"))
    return kept.withColumn("nth", first).where("nth = 1").select("row.*")
