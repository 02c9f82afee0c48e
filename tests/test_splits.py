import pytest
from pyspark.sql import functions as F

from framewise.operators import splits

R = (0.8, 0.1, 0.1)


@pytest.mark.parametrize(
    "n,ratios,want",
    [
        (10, R, (8, 1, 1)), (1, R, (1, 0, 0)), (2, R, (1, 1, 0)), (4, R, (2, 1, 1)), (0, R, (0, 0, 0)),
        (7, (1, 0, 1), (4, 0, 3)), (5, (3, 1, 0), (4, 1, 0)), (100, (8, 1, 1), (80, 10, 10)),
    ],
)
def test_split_sizes(n, ratios, want):
    assert tuple(splits.split_sizes(n, ratios).values()) == want


def test_bad_ratios():
    for bad in ((0, 0, 0), (-1, 1, 1), (float("nan"), 1, 1)):
        with pytest.raises(ValueError):
            splits.split_sizes(5, bad)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "sample_id string")


def test_assign_is_deterministic_and_ordered_by_hash(spark):
    df = ids(spark, "abcdefgh")
    got = {r[0]: r[1] for r in splits.assign(df, "sample_id", 42, (0.5, 0.25, 0.25)).collect()}
    # hash order for seed 42 is h g f e d c b a
    assert got == {**dict.fromkeys("hgfe", "train"), **dict.fromkeys("dc", "val"), **dict.fromkeys("ba", "test")}
    again = {r[0]: r[1] for r in splits.assign(df.repartition(3), "sample_id", 42, (0.5, 0.25, 0.25)).collect()}
    assert got == again


def test_assign_rejects_blank_and_duplicate_ids(spark):
    with pytest.raises(ValueError, match="duplicate"):
        splits.assign(ids(spark, ["a", "a"]), "sample_id", 1, R)
    with pytest.raises(ValueError, match="must not be empty"):
        splits.assign(ids(spark, ["a", " "]), "sample_id", 1, R)


def test_groups_never_cross_splits(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 37).cast("string").alias("segment"))
    held = splits.assign_groups(df, "segment", 5, (0.6, 0.2, 0.2))
    assert held.count() == 400
    row = splits.leakage(held, "segment").first()
    assert (row["leakage_detected"], row["overlap_fraction"], row["overlapping_groups"]) == (False, 0.0, 0)
    mixed = df.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("val"))
    assert splits.leakage(mixed, "segment").first()["leakage_detected"]


def test_batches_sizes_and_determinism(spark):
    df = ids(spark, "abcde")

    def sizes(**kw):
        return [r["count"] for r in splits.batches(df, "sample_id", 2, **kw).groupBy("batch_index").count().orderBy("batch_index").collect()]

    assert sizes() == [2, 2, 1] and sizes(drop_last=True) == [2, 2] and sizes(seed=42) == [2, 2, 1]

    def order(seed, epoch=0):
        return [r["sample_id"] for r in splits.batches(df, "sample_id", 2, seed=seed, epoch=epoch).orderBy("batch_index", "position").collect()]

    assert order(42) == order(42) and sorted(order(7)) == list("abcde") and order(42, 1) == order(43)
    with pytest.raises(ValueError):
        splits.batches(df, "sample_id", 0)


def test_assemble(spark):
    rows = [("a", [float(i) for i in range(12)], [3, 2, 2]), ("b", [float(i) for i in range(12, 24)], [3, 2, 2])]
    df = spark.createDataFrame(rows, "sample_id string, v array<double>, shape array<int>")
    out = splits.assemble(splits.batches(df, "sample_id", 2), "v", "shape").first()
    assert out["batch_shape"] == [2, 3, 2, 2] and out["batch_values"] == [float(i) for i in range(24)]
    mixed = df.withColumn("shape", F.when(F.col("sample_id") == "a", F.array(F.lit(12))).otherwise(F.col("shape")))
    with pytest.raises(Exception, match="share one shape"):
        splits.assemble(splits.batches(mixed, "sample_id", 2), "v", "shape").collect()


def test_sampling_and_filters(spark):
    df = spark.range(10).withColumn("split", F.lit("val"))
    assert [r["id"] for r in splits.every_nth(df, 4, [F.col("id")]).orderBy("id").collect()] == [0, 3, 6, 9]
    assert splits.every_nth(df, 0, [F.col("id")]).count() == 0
    assert [r["id"] for r in splits.first_n(df, 3, [F.col("id").desc()]).collect()] == [9, 8, 7]
    assert splits.only(df, "valid").count() == 10 and splits.only(df, "train").count() == 0 and splits.only(df, "all").count() == 10
    with pytest.raises(ValueError):
        splits.only(df, "other")
    numbered = splits.sequential_id(df, [F.col("id").desc()])
    assert {r["id"]: r["sample_id"] for r in numbered.collect()}[9] == "sample_000000"
