"""The first rows of keys that are mostly different, without a sort in front of the shuffle."""

import pytest
from pyspark.sql import functions as F

from framewise.operators import ordered, rules
from framewise.operators.ordered import first_few, first_k


@pytest.mark.parametrize("limit", [40, 1000, 1 << 20])
def test_first_few_are_the_first_k(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "TASK_ROWS", limit)
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 900).cast("string"))
    df = spark.range(5000).select(key.alias("value"), (F.col("id") % 2).alias("family"), F.xxhash64("id").alias("at"))
    for k in (1, 2, 5):
        want, got = (f(df, ["family", "value"], [F.col("at")], k, "nth").collect() for f in (first_k, first_few))
        assert len(got) == len(want) and set(got) == set(want)


def test_first_few_of_nothing(spark):
    assert first_few(spark.range(0), ["id"], [F.col("id")], 2).collect() == []


def test_unique_values_are_not_sorted_before_the_exchange(spark, monkeypatch):
    """Else a task holds every value of its part of the table."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    df = spark.range(100).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("v"))
    plan = rules.duplicate_field(df, "v", "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("Exchange")[1] and "WindowGroupLimit" not in plan.split("Exchange")[1]


def test_tasks_follow_the_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    df = spark.range(5000).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("v"))
    out = first_few(df, ["v"], [F.col("idx")], 2)
    assert out.rdd.getNumPartitions() == 100
