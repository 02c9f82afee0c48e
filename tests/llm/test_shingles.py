"""The similarity links of the pipeline's near-duplicate stage, against all pairs."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
import nasty
from framewise.llm import shingles


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def changed(text: str, n: int, r: random.Random) -> str:
    words = text.split(" ")
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    r = random.Random(5)
    cases = [(100, 1), (100, 2), (400, 5), (400, 8), (1000, 10), (1000, 20), (100, 6), (400, 30)]
    return [(t := nasty.prose(n, 1000 * k + j), changed(t, c, r)) for k, (n, c) in enumerate(cases) for j in range(25)]


def test_similarity_is_that_of_word_tuples(copies):
    for a, b in copies[::10]:
        assert shingles.similarity(shingles.shingle_set(a), shingles.shingle_set(b)) == jaccard(a, b)


def test_similar_copies_leave_the_corpus(spark, sf_dir, copies):
    docs = nasty.plain(spark, [t for pair in copies for t in pair]).repartition(4)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    likeness = [jaccard(a, b) for a, b in copies]
    close = [i for i, s in enumerate(likeness) if s >= 0.8]
    assert len(close) >= 100 and all(2 * i in left for i in range(len(copies)))
    assert sum(2 * i + 1 not in left for i in close) >= 0.99 * len(close)
    assert all(2 * i + 1 in left for i, s in enumerate(likeness) if s < 0.7)


def test_large_group_of_copies(spark, sf_dir):
    r = random.Random(6)
    base = nasty.prose(400, 77)
    docs = nasty.plain(spark, [base] + [changed(base, 4, r) for _ in range(300)] + ["", "a b", None, "a b c"]).repartition(4)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert left == {0, 301, 302, 304}


def classes(texts, least=0.8):
    """Classes of texts by all pairs."""
    sets = [shingles.shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if shingles.similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def found_classes(spark, texts):
    from pyspark.sql import functions as F

    from framewise.llm.components import components

    docs = nasty.plain(spark, texts).repartition(4)
    rooted = docs.select(F.xxhash64("text").alias("node")).distinct().withColumn("root", F.col("node"))
    roots = {r.node: r.root for r in components(shingles.links(docs, rooted)).collect()}
    names = [r[0] for r in docs.orderBy("doc_id").select(F.xxhash64("text")).collect()]
    return [roots.get(n, n) for n in names]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_a_class_inside_a_crowd_is_whole(spark):
    r = random.Random(11)
    base = nasty.prose(300, 99)
    texts = [changed(base, 3, r) for _ in range(15)] + [changed(base, 6, r) for _ in range(400)]
    want, got = classes(texts), found_classes(spark, texts)
    largest = max(set(want), key=want.count)
    members = [i for i, c in enumerate(want) if c == largest]
    assert len(members) >= 15 and len({got[i] for i in members}) == 1
    linked = [i for i, c in enumerate(want) if want.count(c) > 1]
    assert sum(got.count(got[i]) > 1 for i in linked) >= 0.97 * len(linked)


@pytest.mark.parametrize("crowd", [shingles.CROWD, 40])
def test_crowds_around_the_limit(spark, monkeypatch, crowd):
    monkeypatch.setattr(shingles, "CROWD", crowd)
    r = random.Random(12)
    texts = []
    for k in range(4):
        base = nasty.prose(250, 500 + k)
        texts += [changed(base, r.choice((2, 3, 4, 5, 7)), r) for _ in range(120)]
    want, got = classes(texts), found_classes(spark, texts)
    linked = [i for i, c in enumerate(want) if want.count(c) > 1]
    assert len(linked) > 100 and sum(got.count(got[i]) > 1 for i in linked) >= (0.97 if crowd > 100 else 0.9) * len(linked)
    assert all(len({want[i] for i in range(len(texts)) if got[i] == c}) == 1 for c in set(got))


def test_empty_table_null_ids_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    empty = nasty.plain(spark, [])
    rooted = empty.select(F.xxhash64("text").alias("node"), F.xxhash64("text").alias("root"))
    assert shingles.links(empty, rooted).collect() == []
    base = nasty.prose(200, 4)
    near = changed(base, 1, random.Random(1))
    docs = spark.createDataFrame([(None, base, "en", "s", 0)] * 5 + [(None, near, "en", "s", 0)] * 4 + [(None, None, "en", "s", 0)], nasty.SCHEMA).repartition(3)
    rooted = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")).distinct().withColumn("root", F.col("node"))
    (link,) = shingles.links(docs, rooted).distinct().collect()
    assert {link.a, link.b} == {r[0] for r in spark.createDataFrame([(base,), (near,)], "t string").select(F.xxhash64("t")).collect()}


def crowded(n=4, each=60):
    r = random.Random(13)
    bases = [nasty.prose(250, 700 + k) for k in range(n)]
    return [changed(base, r.choice((4, 5, 6, 7)), r) for base in bases for _ in range(each)]


def test_a_crowd_in_blocks_has_the_links_of_a_whole_one(spark, monkeypatch):
    """Crowds above the limit used to be compared under finer keys, and above it there with two members only."""
    texts = crowded()
    whole = found_classes(spark, texts)
    for most, shingle_limit in ((6, 1 << 20), (2048, 700)):
        monkeypatch.setattr(shingles, "CROWD", most)
        monkeypatch.setattr(shingles, "CROWD_SHINGLES", shingle_limit)
        assert same_partition(found_classes(spark, texts), whole)


def test_members_of_two_roots_meet_in_small_groups(spark):
    """A crowd of 100 with a largest root of 60: groups of a few members, in which all pairs of two roots meet."""
    members = [(7, i, 0 if i < 60 else i % 7 + 1, 10) for i in range(100)] + [(8, i, i % 2, 10) for i in range(9)]
    dealt = shingles._dealt(spark.createDataFrame(members, "key long, node long, root long, n long"), 10, 1 << 20).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.key, r.low, r.high), []).append(r)
    met = {(key, a.node, b.node) for (key, _, _), g in groups.items() for a in g for b in g}
    assert all((k, i, j) in met for k, i, p, _ in members for m, j, q, _ in members if k == m and p != q)
    assert max(map(len, groups.values())) < 40 and len([g for g in groups if g[0] == 8]) == 1


def test_a_group_gives_a_spanning_forest():
    texts = crowded(2, 40)
    sets = [shingles.shingle_set(t) for t in texts]
    found = shingles.crowd_links(np.arange(len(texts)), sets, 0.75)
    assert 0 < len(found) < len(texts) and all(shingles.similarity(sets[i], sets[j]) >= 0.75 for i, j in found)
    root = list(range(len(texts)))
    for i, j in found:
        assert root[i] != root[j]
        root = [root[i] if x == root[j] else x for x in root]
    assert same_partition(root, classes(texts, 0.75))
