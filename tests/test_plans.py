"""Physical plans: no cross joins, no single-partition exchanges on data, early group limits, narrow scans."""

import pytest
from pyspark.sql import functions as F

from framewise.operators import rules
from framewise.operators.ordered import first_k
from framewise.plans.catalog import QUERIES

CHECKED = [
    "align_exact", "align_nearest", "align_stats", "label_attach", "label_backfill", "prepare_samples", "evaluate_predictions", "split_summary",
    "average_precision", "auroc", "regression_metrics", "rd_frontier", "rate_at_quality", "frame_contract", "fetch_plan", "run_eval_priority",
    "int8_codes_asymmetric", "artifact_bytes", "class_prior_baseline", "split_assign", "ordered_batches",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["align_exact", "align_nearest", "label_attach", "error_metrics", "int8_codes_asymmetric", "duplicate_text_lines"])
def test_no_single_partition_exchange(spark, sf_dir, name):
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, sf_dir))


def test_group_limit_runs_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("idx"), "source")
    plan = plan_of(rules.duplicate_field(df, "source", "k", "t"))
    assert plan.count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in plan_of(first_k(df, ["source"], [F.col("idx")], 5))


def test_row_metrics_do_not_shuffle_large_scans(spark, sf_dir, tmp_path):
    from framewise.operators.ratedist import quantized

    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert "Exchange" not in plan_of(quantized(src).select("vec_id", "codes"))


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["auroc"](spark, sf_dir))
    assert "text" not in plan
    plan = plan_of(QUERIES["align_exact"](spark, sf_dir))
    read = " ".join(line.split("ReadSchema", 1)[1] for line in plan.split("\n") if "ReadSchema" in line)
    assert read and "props" not in read and "value" not in read


def test_exact_alignment_moves_frames_twice(spark):
    """Once to rank them in pieces and once to pair them; the other exchanges carry one row for each piece."""
    from framewise.operators import align

    frames = spark.range(100).select(
        F.lit("f").alias("file_name"), F.lit("s").alias("segment"), F.col("id").alias("timestamp_micros"), F.col("id").alias("seq")
    )
    assert plan_of(align.exact(frames, frames)).count("Exchange hashpartitioning") == 4


def test_prepare_moves_images_once(spark, sf_dir):
    """Images come from the last join: nothing above their exchange is another exchange."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(QUERIES["prepare_samples"](spark, sf_dir)).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = [line for line in lines if "image" in line and "Exchange" in line]
    assert len(moved) <= 1
