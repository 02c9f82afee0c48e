"""Tables whose layout keeps work small: untouched files, pruned look-ups, joins without an exchange."""

import os

import pytest
from pyspark.sql import functions as F

from framewise.operators import labels
from framewise.sinks import layout


def parquet_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def folders(files):
    return {os.path.basename(os.path.dirname(f)) for f in files}


@pytest.fixture
def index(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("run-"), "id").alias("run_id"), F.lit(0).cast("long").alias("at"), F.lit("old").alias("status"))
    return layout.BucketTable.create(rows, str(tmp_path / "index"), "run_id", buckets=20)


def test_upsert_rewrites_hit_buckets_only(spark, index):
    before = parquet_files(index.path)
    assert len(before) == 20
    new = spark.createDataFrame([("run-7", 1, "a"), ("run-7", 3, "b"), ("run-7", 2, "c"), ("new-1", 1, "d")], "run_id string, at long, status string")
    index.upsert(new, "at")
    after = parquet_files(index.path)
    hit = {f"bucket={r[0]}" for r in new.select(index._bucket()).distinct().collect()}
    assert {f for f in before if os.path.basename(os.path.dirname(f)) not in hit} == {f for f in after if os.path.basename(os.path.dirname(f)) not in hit}
    assert 1 <= len(hit) <= 2 and folders(set(after) - set(before)) == hit
    got = {r.run_id: (r.at, r.status) for r in index.rows().collect()}
    assert len(got) == 401 and got["run-7"] == (3, "b") and got["new-1"] == (1, "d") and got["run-8"] == (0, "old")
    assert [tuple(r) for r in index.find("run-7").collect()] == [("run-7", 3, "b")]
    assert "PartitionFilters: [isnotnull(bucket" in index.find("run-7")._jdf.queryExecution().executedPlan().toString()


def test_upsert_of_nothing_changes_nothing(spark, index):
    before = parquet_files(index.path)
    index.upsert(index.rows().where("false"), "at")
    assert parquet_files(index.path) == before


def test_append_unique_keeps_every_file(spark, index):
    before = parquet_files(index.path)
    new = spark.createDataFrame([("run-3", 9, "known"), ("x", 2, "second"), ("x", 1, "first"), ("y", 1, "only")], "run_id string, at long, status string")
    assert index.append_unique(new, "at") == 2
    after = parquet_files(index.path)
    assert before.items() <= after.items() and len(after) <= len(before) + 2
    got = {r.run_id: r.status for r in index.rows().collect()}
    assert (got["x"], got["y"], got["run-3"], len(got)) == ("first", "only", "old", 402)
    assert index.append_unique(new, "at") == 0 and parquet_files(index.path) == after


def rows_scanned(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        found, stack = [], [plan]
        while stack:
            node = stack.pop()
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
            if "Scan" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
        return sum(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_look_up_reads_few_row_groups(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(
        F.format_string("sample_%06d", "id").alias("sample_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"), F.rand(1).alias("v")
    )
    path = str(tmp_path / "samples")
    layout.write_by_id(df.repartition(7), path, also=("digest",), group_bytes=1 << 18, ids=50_000)
    one = layout.find(spark, path, "sample_123456")
    assert one.count() == 1 and rows_scanned(spark, layout.find(spark, path, "sample_123456")) <= n / 10
    digest = one.first()["digest"]
    assert layout.find(spark, path, digest, "digest").count() == 1
    assert rows_scanned(spark, layout.find(spark, path, digest, "digest")) <= n / 5
    assert rows_scanned(spark, layout.find(spark, path, "no such digest 0123", "digest")) <= n / 5
    assert layout.find(spark, path, "sample_999999").count() == 0


def test_backfill_leaves_tensors_and_joins_without_exchange(spark, tmp_path):
    samples = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") % 9).alias("segment"), F.col("id").alias("timestamp_micros"), F.array_repeat(F.col("id").cast("double"), 50).alias("range")
    )
    boxes = spark.range(900).select(
        F.lit("f").alias("file_name"), F.concat(F.lit("s"), F.col("id") % 300 % 9).alias("segment"), (F.col("id") % 300).alias("timestamp_micros"), (F.col("id") % 5).cast("int").alias("type")
    )
    valid = samples.where("timestamp_micros % 2 = 0").select(
        F.lit("f").alias("file_name"), "segment", "timestamp_micros", F.lit(3).cast("long").alias("valid_pixels"), F.lit(4).cast("long").alias("total_pixels"), F.lit(0.75).alias("valid_fraction")
    )
    names = {"t": f"samples_{tmp_path.name}".replace("-", "_"), "l": f"labels_{tmp_path.name}".replace("-", "_")}
    layout.write_bucketed(samples, names["t"], str(tmp_path / "t"), labels.FRAME, 6)
    before = parquet_files(tmp_path / "t")
    for part in (boxes.where("type = 1"), boxes):  # the second backfill replaces the first
        layout.write_bucketed(labels.label_table(spark.table(names["t"]), part, valid, 4), names["l"], str(tmp_path / "l"), labels.FRAME, 6)
    out = layout.labelled(spark, names["t"], names["l"], labels.FRAME)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.labelled(spark, names["t"], names["l"], labels.FRAME)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert parquet_files(tmp_path / "t") == before
    want = labels.backfill(samples, boxes, valid, 4)
    assert sorted(map(str, out.select(*sorted(out.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    for t in names.values():
        spark.sql(f"DROP TABLE {t}")
