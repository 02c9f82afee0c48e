"""Scans of real Parquet files, file lists, versioned tables and integrity rules."""

import struct

import pytest
from pyspark.sql import functions as F

from framewise.functions.arrays import doubles
from framewise.operators import labels, rules
from framewise.sources import filesets, scan, tables

RAW_CAMERA = "`key.segment_context_name` string, `key.frame_timestamp_micros` bigint, `key.camera_name` tinyint, `[CameraImage].image` binary, seq bigint"


@pytest.fixture(scope="module")
def camera_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cam") / "t")
    rows = [("s", 100 + i, 1 + i % 2, bytes([i]), i) for i in range(10)]
    spark.createDataFrame(rows, RAW_CAMERA).coalesce(1).write.parquet(path)
    return path


def test_camera_scan_filters_caps_and_pushes_down(spark, camera_dir):
    raw = spark.read.parquet(camera_dir)
    frames = scan.camera_frames(raw)
    assert [r["timestamp_micros"] for r in frames.orderBy("seq").collect()] == [100, 102, 104, 106, 108]
    capped = scan.camera_frames(raw, sensor=2, max_per_file=2)
    assert [r["seq"] for r in capped.orderBy("seq").collect()] == [1, 3]
    narrow = frames.select("segment", "timestamp_micros")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan and "key.camera_name" in plan.split("PushedFilters")[1]
    assert "image" not in plan.split("ReadSchema")[1]


def test_missing_columns_name_the_schema(spark):
    df = spark.createDataFrame([(1, "x")], "a int, `image` string")
    with pytest.raises(ValueError, match="a: int"):
        scan.find_column(df, "camera_name")
    with pytest.raises(ValueError):
        scan.camera_frames(df)


def test_lidar_nulls_and_short_shapes(spark):
    ddl = "`key.segment_context_name` string, `key.frame_timestamp_micros` bigint, `key.laser_name` int, `a.range_image_return1.values` array<float>, `a.range_image_return1.shape` array<int>, seq bigint, file_name string"
    df = spark.createDataFrame([("s", 1, 1, None, None, 0, "f"), ("s", 2, 1, [1.0, 2.0], [1, 1, 2], 1, "f"), ("s", 3, 2, None, None, 2, "f")], ddl)
    got = scan.lidar_frames(df).orderBy("seq").collect()
    assert [(r["range_values"], r["shape"]) for r in got] == [([], [0, 0, 0]), ([1.0, 2.0], [1, 1, 2])]
    bad = spark.createDataFrame([("s", 1, 1, [1.0], [1, 1], 0, "f")], ddl)
    with pytest.raises(Exception, match="three entries"):
        scan.lidar_frames(bad).collect()


def test_sensor_ids(spark):
    wide = spark.createDataFrame([(300,)], "id int")
    with pytest.raises(Exception, match="out of range"):
        wide.select(scan.sensor_id(wide, "id")).collect()
    with pytest.raises(ValueError, match="expected tinyint or int"):
        scan.sensor_id(spark.createDataFrame([(1,)], "id bigint"), "id")


def test_box_counts_golden(spark):
    ddl = "`key.segment_context_name` string, `key.frame_timestamp_micros` bigint, `key.camera_name` tinyint, `[CameraBoxComponent].type` int"
    rows = [("s", 100, 1, 1), ("s", 100, 1, 2), ("s", 100, 2, 1), ("s", 200, 1, 3), ("s", 300, 1, 9)]
    counts = labels.presence(labels.box_counts(scan.box_rows(spark.createDataFrame(rows, ddl))))
    got = {r["timestamp_micros"]: r.asDict() for r in counts.collect()}
    assert set(got) == {100, 200}
    assert (got[100]["vehicle_count"], got[100]["pedestrian_count"], got[100]["cyclist_present"]) == (1, 1, 0)
    assert (got[200]["sign_count"], got[200]["sign_present"]) == (1, 1)
    samples = spark.createDataFrame([("s", 100), ("s", 150)], "segment string, timestamp_micros bigint")
    attached = {r["timestamp_micros"]: r for r in labels.attach(samples, labels.box_counts(scan.box_rows(spark.createDataFrame(rows, ddl)))).collect()}
    assert attached[150]["vehicle_count"] == 0 and attached[150]["vehicle_present"] == 0 and attached[100]["vehicle_present"] == 1


def test_listing_golden(spark):
    text = ["  42  2024-01-01  gs://b/training/camera_image/a.parquet", "gs://b/training/camera_image/", "100 x gs://b/training/lidar/b.parquet extra", "TOTAL: 2 objects"]
    df = spark.createDataFrame(list(enumerate(text)), "n int, value string")
    rows = filesets.listing(df, "training", order="n").orderBy("n").collect()
    assert [(r["file_name"], r["size_bytes"]) for r in rows] == [("a.parquet", 42), ("b.parquet", 100)]
    assert filesets.listing(df, "training", limit=1, order="n").count() == 1


def test_selection_and_plan_golden(spark):
    files = spark.createDataFrame([("a", "training", 0), ("b", "training", 1), ("c", "training", 2), ("d", "validation", 3), ("e", "testing", 4)], "uri string, split string, seq bigint")
    chosen = filesets.top_per_split(files, {"training": 2, "validation": 1})
    assert sorted(r["uri"] for r in chosen.collect()) == ["a", "b", "d"]
    raw = spark.createDataFrame(
        [(f"u{i}", p, 1) for i, p in enumerate(["train/c", "Training/a", "train/b", "val/d", "x/valid/e", "testing/f"])], "object_uri string, object_path string, size_bytes bigint"
    )
    plan, warnings = filesets.fetch_plan(raw, {"train": 1, "val": 1, "test": 2})
    rows = plan.orderBy("plan_index").collect()
    assert [(r["plan_index"], r["split"]) for r in rows] == [(0, "train"), (1, "val"), (2, "test")]
    assert [(r["requested"], r["available"]) for r in warnings.collect()] == [(2, 1)]
    limited, _ = filesets.fetch_plan(raw, limit=3)
    assert [(r["plan_index"], r["split"]) for r in limited.orderBy("plan_index").collect()] == [(0, "train"), (1, "train"), (2, "train")]


def test_paths(spark):
    df = spark.createDataFrame([("x/Camera_Image/f.parquet",), ("x/lidar/f.parquet",), ("camera_image/f",)], "p string")
    assert [r[0] for r in df.select(filesets.box_path(F.col("p"))).collect()] == ["x/camera_box/f.parquet", "x/lidar/f.parquet", "camera_box/f"]
    short = spark.createDataFrame([("gs://b/x.parquet", "training", "x.parquet"), ("gs://b/training/lidar/x.parquet", "training", "x.parquet")], "uri string, split string, file_name string")
    assert [r[0] for r in short.select(filesets.target_path("out")).collect()] == ["out/training/x.parquet", "out/training/lidar/x.parquet"]


def test_tensor_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<3f", 1.5, -2.0, 0.25))
    row = tables.tensor_files(spark, str(tmp_path / "a.bin")).first()
    assert row["values"] == [1.5, -2.0, 0.25] and row["length"] == 12
    half = spark.createDataFrame([(bytearray(struct.pack("<4e", 1.0, 6e-8, float("inf"), -0.5)),)], "b binary")
    got = half.select(tables.decode(F.col("b"), "f16").alias("v")).first()["v"]
    assert got[0] == 1.0 and 0 < got[1] < 1e-7 and got[2] == float("inf") and got[3] == -0.5
    assert half.select(doubles(tables.decode(F.col("b"), "u8")).alias("v")).first()["v"][1] == 60.0
    with pytest.raises(Exception, match="multiple"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(tables.decode(F.col("b"))).collect()


def test_versioned_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1,)], "a int"), path, 3)
    schema = "a int, schema_version int"
    assert tables.read_table(spark, path, schema, 3).first()["a"] == 1
    with pytest.raises(Exception, match="expected schema version 4, found 3"):
        tables.read_table(spark, path, schema, 4).collect()
    with pytest.raises(Exception, match="expected schema version 4, found 3"):
        tables.read_table(spark, path, schema, 4).count()
    with pytest.raises(Exception, match="expected schema version 4, found 3"):
        tables.read_table(spark, path, schema, 4).select("a").collect()
    broken = tmp_path / "broken.json"
    broken.write_text('{"a": 1, "schema_version": 3}\n\n{"a": \n{"a": 2, "schema_version": 9}\n')
    got = {r["kind"] for r in tables.corrupt_rows(spark, str(broken), schema, 3).collect()}
    assert got == {"malformed", "version_mismatch"}


def test_duplicates_are_reported_once_at_the_second_place(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, " "), (4, " "), (5, "y")], "idx int, v string")
    got = [tuple(r) for r in rules.duplicate_field(df, "v", "k", "t").collect()]
    assert got == [("k", "t[1].v", "v again: x")]


def test_latest_rules_on_nothing(spark):
    empty = spark.createDataFrame([], "idx int, name string, manifest_path string, schema_version int")
    assert [r["location"] for r in rules.latest_rules(empty, {"raw_files": 1}).collect()] == ["latest"]


def test_version_rule(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "idx int, schema_version int")
    got = [r["message"] for r in rules.rules(df, [rules.version_is(1)], "k", "t").collect()]
    assert got == ["schema version should be 1, is 2", "schema version should be 1, is none"]


def test_a_bad_metrics_line_stops_the_read(spark, tmp_path):
    lines = tmp_path / "epochs.json"
    lines.write_text('{"epoch": 0}\n\n{"epoch": 1}\n')
    assert tables.epoch_metrics(spark, str(lines), "epoch int").count() == 2
    lines.write_text('{"epoch": 0}\n{"epoch": \n')
    with pytest.raises(Exception):
        tables.epoch_metrics(spark, str(lines), "epoch int").collect()


def test_a_sensor_id_out_of_range_raises(spark):
    ddl = "`key.segment_context_name` string, `key.frame_timestamp_micros` bigint, `key.camera_name` int, `x[CameraBoxComponent].type` int, `c.image` binary, seq bigint, file_name string"
    df = spark.createDataFrame([("s", 1, 300, 1, b"x", 0, "f")], ddl)
    with pytest.raises(Exception, match="sensor id out of range"):
        scan.camera_frames(df).count()
    with pytest.raises(Exception, match="sensor id out of range"):
        scan.box_rows(df).collect()


def test_normalization_row(spark):
    from framewise.sinks import writers

    row = writers.normalization_row(spark, ["range", "intensity"]).first()
    assert row["lidar_sensor"] == 1 and row["output_channels"] == ["range", "intensity"] and row["max_range_meters"] > 0
