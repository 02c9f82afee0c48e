"""The nearest point of each curve: ties, nulls, and how much is sorted."""

import random
import re

from pyspark.sql import functions as F

from framewise.operators import ratedist

SCHEMA = "curve string, idx long, rate double, psnr_db double, mode string"


def test_ties_and_nulls(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", "c", None]), i, draw.choice([1.0, 2.0, 3.0, None, float("nan")]), draw.choice([10.0, 20.0, 30.0, float("nan")]), "m") for i in range(400)]
    rows += [("d", 1, None, None, "m"), ("d", 2, 1.0, 10.0, "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = [10.0, 25.0]
    got = {(r.curve, r.target): r.idx for r in ratedist.nearest(df, targets).collect()}
    exploded = df.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    order = F.struct(F.abs(F.col("psnr_db") - F.col("target")), F.col("rate"), F.col("idx"))
    want = {(r.curve, r.target): r.idx for r in exploded.groupBy("curve", "target").agg(F.min_by("idx", order).alias("idx")).collect()}
    assert got == want and len(got) == 10


def test_points_are_reduced_before_they_are_sorted(spark):
    df = spark.range(1000).select(F.lit("a").alias("curve"), F.col("id").alias("idx"), F.col("id").cast("double").alias("rate"), (F.col("id") % 50).cast("double").alias("psnr_db"), F.lit("m").alias("mode"))
    plan = ratedist.nearest(df, [10.0])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("HashAggregate", plan)) >= 4 and "Join" in plan
