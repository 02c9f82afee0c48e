"""Phrase growth against plain counting, in one round and in many, and its helpers."""

import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, top, min_count):
    """Ranked phrases by whole counts of all phrases; ``docs`` are (lang, text)."""
    counts, words = {}, Counter()
    for lang, text in docs:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            words[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                f.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {}
        for p, a in f.items():
            if len(p) > 1 and a >= min_count:
                s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found[p] = (a, left, right, s)
        covered = {q for p, (a, *_) in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        kept = sorted((-s, -a, " ".join(p).encode(), left, right) for p, (a, left, right, s) in found.items() if p not in covered)
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def corpus(seed, n_docs=120):
    r = random.Random(seed)
    vocabulary = ["Of", "the", "THE", "ab", "é", "É", "x|y", "漢字", "new", "york", "city", "a", "b", "c"] + [f"w{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(n_docs):
        words = []
        for _ in range(r.randint(0, 80)):
            words.append(r.choices(vocabulary, weights)[0])
            if r.random() < 0.1:
                words += ["New", "York", "city"][: r.choice((2, 3, 3))]
            if r.random() < 0.12:
                words[-1] += r.choice(".,;:!?\n\r\x0b\x0c")
        docs.append((r.choice(["en", "en", "en", "de", None]), r.choice((" ", "\t", "  ")).join(words)))
    return docs + [("xx", "a b a b"), (None, None), ("en", ""), ("en", " \t\n")]


def frame(spark, docs):
    rows = [(1, t, lang, "s", 0) for lang, t in docs]
    df = spark.createDataFrame(rows, nasty.SCHEMA).repartition(5)
    return df.select("*", *[F.lit("clash").alias(c) for c in (*nasty.CLASHES, "phrase", "n", "rank", "l", "r", "a")])


@pytest.mark.parametrize("top, min_count, first_rank", [(2000, 10, None), (15, 4, 3), (40, 3, 40), (5, 10, 1), (1, 2, 1)])
def test_plain_counts(spark, top, min_count, first_rank):
    docs = corpus(top)
    out = co.collocations(frame(spark, docs), top=top, min_count=min_count, first_rank=first_rank).collect()
    assert sorted(tuple(r) for r in out) == brute(docs, top, min_count)


def test_repeated_rows_and_long_pieces(spark, monkeypatch):
    r = random.Random(3)
    long_piece = " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(20_000))
    docs = [("en", "same row again and again")] * 30 + [("en", long_piece), ("en", "x" * 70_000 + " " + "y" * 70_000 + " a b c")]
    monkeypatch.setattr(co, "SLICE", 1000)
    monkeypatch.setattr(co, "FLUSH_BYTES", 3000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [d[0] for d in docs], "text": [d[1] for d in docs]})
    words = co.Filter(spark.createDataFrame([(i,) for i in range(3)], "h long"))
    words.bits[:] = 255
    for length, run in ((2, lambda: co._count_pairs(iter([batch]), words)), (3, lambda: co._count_triples(iter([batch]), words, words, words, words))):
        got = Counter()
        for part in run():
            for p, n in zip(part.column("phrase").to_pylist(), part.column("n").to_pylist()):
                got[p] += n
        want = Counter()
        for _, text in docs:
            ws = text.split()
            want.update(" ".join(ws[i : i + length]) for i in range(len(ws) - length + 1))
        assert got == want


def test_awkward_and_empty_tables(spark):
    out = co.collocations(nasty.table(spark), top=50).collect()
    assert sorted(tuple(r) for r in out) == brute([(r[2], r[1]) for r in nasty.rows()], 50, 10)
    assert co.collocations(nasty.table(spark, [])).collect() == []


def test_pair_hash_is_sparks(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("x"), F.xxhash64(F.col("id") + 7).alias("y")).select("x", "y", F.xxhash64("x", "y").alias("h"))
    x, y, h = (np.array(c, np.int64).astype(np.uint64) for c in zip(*rows.collect()))
    assert (co.pair_hash(x, y) == h).all()


def test_filter_has_no_false_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = co.Filter(keys)
    assert f.has(np.array([r.h for r in keys.collect()], np.int64).astype(np.uint64)).all()
    others = np.array([r.h for r in spark.range(10_000, 15_000).select(F.xxhash64("id").alias("h")).collect()], np.int64).astype(np.uint64)
    assert f.has(others).mean() < 0.1


def test_score_past_64_bits(spark):
    row = spark.range(1).select(co.score(*[F.lit(x) for x in (98_765_432_109_876, 99_999_999_999_999, 98_765_432_109_877)]).alias("s")).first()
    assert row.s == 1_000_000 * 98_765_432_109_876**2 // (99_999_999_999_999 * 98_765_432_109_877)
