"""Queries on training runs and their evaluations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewise.operators import runs
from framewise.plans import views
from framewise.plans.registry import Registry, r6
from framewise.session import remember, shared_dir
from framewise.sinks import layout

reg = Registry()

RUNS = """ru AS (SELECT s_suppkey AS run_order, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '|b' ELSE s_name END AS run_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'range-only' WHEN 1 THEN 'rgb-only' ELSE 'fusion' END AS model, (s_suppkey % 4 + 1)::INT AS epochs,
  abs(s_acctbal) / 10000 AS final_train_loss, CASE WHEN s_suppkey % 6 <> 0 THEN abs(s_acctbal) / 9000 END AS final_val_loss, 'cpu' AS backend FROM supplier),
  ev AS (SELECT run_name, run_order, split, run_order % 50 + 1 AS n_samples, model <> 'range-only' AS g, model <> 'rgb-only' AS r, final_train_loss * length(split) AS s
    FROM ru, (VALUES ('train'), ('val'), ('test')) v(split)
    WHERE (split = 'train' AND run_order % 2 = 0) OR (split = 'val' AND run_order % 3 = 0) OR (split = 'test' AND run_order % 5 < 2))"""
BEST = "be AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY CASE split WHEN 'val' THEN 0 WHEN 'test' THEN 1 ELSE 2 END) = 1)"


def run_table(spark, d):
    return views.run_table(views.table(spark, d, "supplier"))


def eval_table(spark, d):
    return views.eval_table(views.table(spark, d, "supplier"))


@reg.add("run_eval_priority", f"WITH {RUNS}, {BEST} SELECT ru.run_name, ru.run_order, split AS eval_split, round(CASE WHEN g THEN s END, 6) AS rgb_mse FROM ru LEFT JOIN be USING (run_name)")
def run_eval_priority(spark, d):
    return runs.with_eval(run_table(spark, d), eval_table(spark, d)).select("run_name", "run_order", "eval_split", r6("rgb_mse"))


def _cell(v: str, when: str = "true") -> str:
    return f"coalesce(CASE WHEN {when} THEN printf('%.6f', {v}) END, '-')"


def _f32(v: str) -> str:
    return f"({v})::FLOAT::DOUBLE"


@reg.add(
    "run_comparison",
    f"""WITH {RUNS}, {BEST} SELECT ru.run_order, replace(ru.run_name, '|', '\\|') AS run_name, model, epochs::VARCHAR AS epochs, printf('%.6f', final_train_loss) AS final_train_loss,
    {_cell('final_val_loss')} AS final_val_loss, backend, coalesce(split, '-') AS eval_split, {_cell(_f32('s'), 'g')} AS rgb_mse, {_cell(_f32('s * 20'), 'g')} AS rgb_psnr, {_cell(_f32('s / 4'), 'g')} AS rgb_ssim,
    {_cell(_f32('s * 2'), 'r')} AS range_mse, {_cell(_f32('s * 30'), 'r')} AS range_psnr, {_cell(_f32('s * 3'), 'r')} AS range_depth_mae_m, {_cell(_f32('s / 3'), 'r')} AS range_valid_frac
    FROM ru LEFT JOIN be USING (run_name)""",
)
def run_comparison(spark, d):
    return runs.comparison(run_table(spark, d), eval_table(spark, d))


@reg.add(
    "run_comparison_without_eval",
    f"""WITH {RUNS} SELECT run_order, replace(run_name, '|', '\\|') AS run_name, model, epochs::VARCHAR AS epochs, printf('%.6f', final_train_loss) AS final_train_loss,
    {_cell('final_val_loss')} AS final_val_loss, backend FROM ru""",
)
def run_comparison_without_eval(spark, d):
    return runs.comparison(run_table(spark, d), eval_table(spark, d).where("split = 'none'"))


@reg.add(
    "run_report_rows",
    f"""WITH {RUNS} SELECT run_name, split, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS split_order, n_samples, 0 AS modality_order, 'RGB' AS modality,
      printf('%.6f', (s)::FLOAT::DOUBLE) AS mean_mse, printf('%.6f', (s * 20)::FLOAT::DOUBLE) AS mean_psnr, printf('%.6f', (s / 4)::FLOAT::DOUBLE) AS mean_ssim, '-' AS mean_depth_mae_m, '-' AS mean_valid_fraction FROM ev WHERE g
    UNION ALL SELECT run_name, split, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, n_samples, 1, 'Range', printf('%.6f', (s * 2)::FLOAT::DOUBLE), printf('%.6f', (s * 30)::FLOAT::DOUBLE), '-',
      printf('%.6f', (s * 3)::FLOAT::DOUBLE), printf('%.6f', (s / 3)::FLOAT::DOUBLE) FROM ev WHERE r""",
)
def run_report_rows(spark, d):
    return runs.report_rows(eval_table(spark, d))


EPOCHS = """ep AS (SELECT l_returnflag || l_linestatus AS run_name, date_diff('month', DATE '1900-01-01', l_shipdate)::BIGINT AS month, sum(l_discount * l_quantity) / sum(l_quantity) AS loss FROM lineitem GROUP BY 1, 2)"""


def epoch_table(spark, d):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - (1900 * 12 + 1)
    batches = views.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("run_name"), month.cast("bigint").alias("month"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("batch_size")
    )
    return runs.epoch_loss(batches, ["run_name", "month"])


@reg.add("epoch_loss", f"WITH {EPOCHS} SELECT run_name, month, round(loss, 6) AS loss FROM ep")
def epoch_loss(spark, d):
    return epoch_table(spark, d).select("run_name", "month", r6("loss"))


@reg.add("seed_interval", f"WITH {EPOCHS} SELECT run_name, round(avg(loss), 6) AS mean, round(min(loss), 6) AS lo, round(max(loss), 6) AS hi, count(*) AS n_seeds FROM ep GROUP BY 1")
def seed_interval(spark, d):
    return runs.seed_ci(epoch_table(spark, d), ["run_name"], "loss").select("run_name", r6("mean"), r6("lo"), r6("hi"), "n_seeds")


@reg.add(
    "epoch_curve_buckets",
    f"""WITH {EPOCHS}, n AS (SELECT run_name, loss, row_number() OVER (PARTITION BY run_name ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY run_name) AS n FROM ep),
    s AS (SELECT run_name, slot, loss FROM n, range(10) r(slot) WHERE i = floor(slot * (n - 1) / 9.0::DOUBLE + 0.5)),
    b AS (SELECT run_name, list(loss ORDER BY slot) AS v FROM s GROUP BY 1)
    SELECT run_name, array_to_string(list_transform(v, lambda e: CASE WHEN list_max(v) - list_min(v) < 2.220446049250313e-16 THEN 0 ELSE floor((e - list_min(v)) / (list_max(v) - list_min(v)) * 7 + 0.5)::INT END), ',') AS buckets FROM b""",
)
def epoch_curve_buckets(spark, d):
    ranked = epoch_table(spark, d).withColumnRenamed("month", "epoch")
    out = runs.curve_buckets(ranked, ["run_name"])
    return out.select("run_name", F.array_join(F.transform("buckets", lambda b: b.cast("string")), ",").alias("buckets"))


UPSERTED = """WITH n AS (SELECT 'run-' || o_custkey AS run_id, o_orderkey, o_orderstatus AS status FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT * FROM n UNION ALL SELECT 'run-' || c_custkey, 0, 'old' FROM customer WHERE 'run-' || c_custkey NOT IN (SELECT run_id FROM n)"""


def _run_index(spark, d):
    """An index with every customer as an old run, and every order as a new one."""
    old = views.table(spark, d, "customer").select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"), F.lit(0).cast("bigint").alias("o_orderkey"), F.lit("old").alias("status")
    )
    new = views.table(spark, d, "orders").select(
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"), "o_orderkey", F.col("o_orderstatus").alias("status")
    )
    return old, new


@reg.add("run_index_upsert_all", UPSERTED)
def run_index_upsert_all(spark, d):
    return runs.upsert(*_run_index(spark, d), order="o_orderkey")


@reg.add("run_index_buckets", UPSERTED)
def run_index_buckets(spark, d):
    """The same upsert into an index in buckets of the run id, of which only those that new runs hit are rewritten."""
    old, new = _run_index(spark, d)
    path = remember(f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}")
    index = layout.BucketTable.create(old, path, "run_id", buckets=16)
    index.upsert(new, "o_orderkey")
    return index.rows()
