"""Ranking by counts of leading digits, cuts of hashes, and shuffles by permutation, against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framewise.functions.permute import Permutation
from framewise.operators import joins, radix, ranking, splits

SCORES = "class string, idx bigint, label int, score double"


def plain(rows):
    """AP, AUROC, f1 and balanced accuracy per class."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((-s, i, l) for k, i, l, s in rows if k == c)
        hits, terms = 0, []
        for rank, (_, _, l) in enumerate(mine, 1):
            hits += l
            terms += [hits / rank] if l else []
        pos, neg = [-s for s, _, l in mine if l], [-s for s, _, l in mine if not l]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
        fn, tn = len(pos) - tp, len(neg) - fp
        out[c] = {
            "average precision": sum(terms) / len(terms) if terms else None, "auroc": won / (len(pos) * len(neg)) if pos and neg else None,
            "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None, "balanced accuracy": (tp / len(pos) + tn / len(neg)) / 2 if pos and neg else None,
        }
    return out


def scored(seed):
    r = random.Random(seed)
    rows = []
    for c, n, make in (
        ("spread", 300, r.random), ("tiny", 200, lambda: r.random() * 1e-9), ("steps", 300, lambda: r.randint(0, 8) / 8), ("one", 260, lambda: 0.25),
        ("edges", 120, lambda: r.choice([0.0, 1.0, 0.5, 0.5 - 1e-12])), ("mixed", 300, lambda: r.choice([0.75, r.random()])),
    ):
        rows += [(c, i, int(r.random() < 0.3), make()) for i in range(n)]
    rows += [("none", i, 0, r.random()) for i in range(90)] + [("all", i, 1, r.random()) for i in range(90)] + [("single", 0, 1, 0.4)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf, fanout", [(1 << 18, 256), (40, 256), (7, 4)])
def test_metrics_at_any_leaf_size(spark, monkeypatch, leaf, fanout):
    monkeypatch.setattr(radix, "LEAF_ROWS", leaf)
    monkeypatch.setattr(radix, "FANOUT", fanout)
    monkeypatch.setattr(radix, "FIRST", 16)
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    monkeypatch.setattr(joins, "HOT_PARTS", 20)
    rows = scored(leaf)
    df = spark.createDataFrame(rows, SCORES).repartition(5)
    tree = ranking.score_tree(df)
    assert (len(tree.counts) > 1) == (leaf < 100)
    want = plain(rows)
    for r in ranking.per_class(df).collect():
        value = want[r["class"]][r["metric"]]
        assert (r["value"] is None and value is None and r["na_reason"]) or math.isclose(r["value"], value, rel_tol=1e-12), (r, value)


def test_one_reading_and_no_range_exchange(spark, tmp_path):
    spark.createDataFrame(scored(1), SCORES).write.parquet(str(tmp_path / "scores"))
    source = spark.read.parquet(str(tmp_path / "scores"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    out = ranking.per_class(source.mapInArrow(seen, SCORES))
    plan = out._jdf.queryExecution().toString()
    out.collect()
    assert read.value == source.count()
    assert "rangepartitioning" not in plan


def test_a_null_class_is_an_error(spark):
    with pytest.raises(Exception, match="null in a key"):
        ranking.per_class(spark.createDataFrame([(None, 1, 1, 0.5)], SCORES))


def test_cut_keys_against_a_sort(spark, monkeypatch):
    monkeypatch.setattr(radix, "FEW", 3)
    r = random.Random(4)
    rows = [(r.choice([5, 5 << 16, (5 << 16) + 1, r.getrandbits(32)]), r.choice([7, 7, r.getrandbits(32)]), f"id{i:04d}") for i in range(400)]
    rows += [(5, 7, f"same{i}") for i in range(30)]
    keys = spark.createDataFrame(rows, "hi bigint, lo bigint, name string").repartition(4)
    ordered = sorted(rows)
    ranks = [0, 1, 17, 40, 41, 100, 101, 250, 429, 430]
    assert radix.cut_keys(keys, "name", ranks) == [None if k == 0 else ordered[k - 1] for k in ranks]


def test_assign_sorts_nothing(spark):
    df = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("sample_id"))
    out = splits.assign(df, "sample_id", 3, (0.7, 0.2, 0.1))
    assert "rangepartitioning" not in out._jdf.queryExecution().toString() and "Window" not in out._jdf.queryExecution().toString()
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 3500, "val": 1000, "test": 500}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1024, 5000])
def test_permutation_is_a_bijection(n):
    p = Permutation(n, 5)
    places = [p.place(i) for i in range(n)]
    assert sorted(places) == list(range(n)) and all(p.back(y) == i for i, y in enumerate(places))
    if n > 50:
        assert places != [Permutation(n, 6).place(i) for i in range(n)]
        assert sum(abs(y - i) for i, y in enumerate(places)) > n * n / 5


def test_permutation_column(spark):
    for n in (1, 7, 1000, 10**15 + 7):
        p = Permutation(n, 11)
        numbers = sorted({min(n - 1, k) for k in (0, 1, 2, 3, 5, 6, n // 3, n - 1)})
        df = spark.createDataFrame([(k,) for k in numbers], "k bigint")
        assert [r["y"] for r in df.select("k", p.column(F.col("k")).alias("y")).orderBy("k").collect()] == [p.place(k) for k in numbers]
    with pytest.raises(Exception, match="outside"):
        spark.range(3).select(Permutation(2, 1).column(F.col("id")).alias("y")).collect()


def test_shuffled_epochs_and_single_batches(spark, tmp_path):
    df = spark.range(1037).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("sample_id"), "id")
    splits.numbered(df, "sample_id").sort("row_number").write.parquet(str(tmp_path / "numbered"))
    rows = spark.read.parquet(str(tmp_path / "numbered"))
    epochs = []
    for epoch in (0, 1):
        out = splits.shuffled(rows, 1037, 64, 9, epoch)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["batch_index"], r["position"], r["sample_id"]) for r in out.collect())
        assert [g[:2] for g in got] == [(i // 64, i % 64) for i in range(1037)] and len({g[2] for g in got}) == 1037
        epochs.append(got)
    assert [g[2] for g in epochs[0]] != [g[2] for g in epochs[1]]
    for b in (0, 7, 16, 17):
        one = splits.one_batch(rows, 1037, 64, 9, 1, b)
        assert sorted((r["batch_index"], r["position"], r["sample_id"]) for r in one.collect()) == [g for g in epochs[1] if g[0] == b]
    assert "PushedFilters: [In(row_number" in splits.one_batch(rows, 1037, 64, 9, 1, 3)._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(row_number), ", "")
    assert splits.shuffled(rows, 1037, 64, 9, drop_last=True).count() == 1024
    assert sorted(r["sample_id"] for r in splits.batches(df, "sample_id", 64, seed=9, epoch=1).where("batch_index = 7").collect()) == sorted(g[2] for g in epochs[1] if g[0] == 7)
