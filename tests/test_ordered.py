"""Ranks and running values in pieces against pandas, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators.ordered import first_k, first_per_key, rank_by_seq, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame(
        {"g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n)), "k": rng.integers(0, 400, n), "seq": np.arange(n), "v": rng.integers(0, 9, n)}
    )
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("bucket", [None, "k"])
def test_running_values(skewed, bucket):
    pdf, df = skewed
    out = running(
        df, ["g"], [F.col("k"), F.col("seq")], bucket=None if bucket is None else F.floor(F.col("k") / 50), rank="r", sums={"s": F.col("v")},
        max_before={"before": F.col("v")}, max_through={"through": F.col("v")},
    ).toPandas().sort_values(["g", "k", "seq"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "k", "seq"]).reset_index(drop=True)
    by = want.groupby("g")
    assert (out["r"] == by.cumcount() + 1).all()
    assert (out["s"] == by["v"].cumsum()).all()
    assert (out["through"] == by["v"].cummax()).all()
    before = by["v"].cummax().groupby(want["g"]).shift(1)
    assert out["before"].isna().equals(before.isna()) and (out["before"].dropna() == before.dropna()).all()


def test_global_rank(skewed):
    pdf, df = skewed
    out = running(df, [], [F.col("v").desc(), F.col("seq")], rank="r").toPandas().sort_values("r")
    want = pdf.sort_values(["v", "seq"], ascending=[False, True])
    assert out["r"].tolist() == list(range(1, len(pdf) + 1)) and out["seq"].tolist() == want["seq"].tolist()


def test_first_k_beyond_the_group_limit(skewed):
    pdf, df = skewed
    for k in (2, 1200):
        out = first_k(df, ["g"], [F.col("seq")], k).toPandas().sort_values("seq")
        want = pdf.sort_values("seq").groupby("g").head(k)
        assert out["seq"].tolist() == want["seq"].tolist()


def test_ranks_of_hot_groups(skewed, monkeypatch):
    from framewise.operators import ordered

    pdf, df = skewed
    for width in (1 << 17, 100):
        monkeypatch.setattr(ordered, "SEQ_WIDTH", width)
        out = rank_by_seq(df, ["g"], "seq", "r", descending=True).toPandas().sort_values("seq")
        want = pdf.sort_values("seq").groupby("g")["seq"].rank(ascending=False).astype(int)
        assert out["r"].tolist() == want.tolist()


def test_more_than_a_hundred_large_groups(spark):
    df = spark.range(30_000).select(F.col("id").alias("seq"), (F.col("id") % 150).alias("g"))
    out = rank_by_seq(df, ["g"], "seq", "r")
    assert out.where("r != seq div 150 + 1").count() == 0 and out.count() == 30_000


def test_null_keys_raise(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, seq long")
    with pytest.raises(Exception, match="null in a key"):
        running(df, ["g"], [F.col("seq")], rank="r").collect()


def test_first_per_key_keeps_first_and_last(skewed):
    pdf, df = skewed
    first = {r["g"]: r["seq"] for r in first_per_key(df, ["g"], F.col("seq")).collect()}
    last = {r["g"]: r["seq"] for r in first_per_key(df, ["g"], F.col("seq"), last=True).collect()}
    assert first == pdf.groupby("g")["seq"].min().to_dict() and last == pdf.groupby("g")["seq"].max().to_dict()


def test_staged_tables_are_released(spark):
    from framewise import session

    session.release_staged(spark)
    kept = session.stage(spark.range(5))
    assert kept.count() == 5 and session.release_staged(spark) == 1 and session.release_staged(spark) == 0


def test_a_scope_deletes_what_it_staged(spark, sf_dir):
    import os

    from framewise import session
    from framewise.plans.catalog import QUERIES

    folder = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for name in ("align_nearest", "rd_frontier", "sample_table_write", "epoch_metrics_scan"):
        with session.staging(spark):
            assert QUERIES[name](spark, sf_dir).count() > 0
        assert set(os.listdir(folder)) <= before
