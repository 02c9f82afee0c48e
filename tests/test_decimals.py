"""Six decimals of text cells against C's formatting, halves of the exact value to even."""

import random

from pyspark.sql import functions as F

from framewise.functions.arrays import fixed6
from framewise.operators import runs
from framewise.sinks import writers

TIES = {0.0078125: "0.007812", 0.0234375: "0.023438", 83.4375: "83.437500", 83.8515625: "83.851562", 0.6953125: "0.695312"}


def test_six_decimals_are_those_of_the_exact_value(spark):
    draw = random.Random(7)
    values = [*TIES, 0.1234565, 0.1234575, 1.0000005, 0.9999995, 0.9999999, 4.9e-324, 5e-7, 1.5e-6, 2.0**52 + 0.5, 2.0**53 - 1, 9e18, 0.0, -0.0]
    values += [draw.randrange(1, 1 << 30) / 128 for _ in range(500)]
    values += [draw.randrange(10**10) / 10**7 + (5e-7 if k % 2 else 0) for k in range(2000)]
    values += [draw.random() * 10.0 ** draw.randrange(-12, 15) for _ in range(2000)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fixed6(F.col("v"))).collect()] == ["%.6f" % v for v in values]


def _evals(spark):
    rows = [(f"r{k}", "val", 3, v, v, v, v, v, v, v) for k, v in enumerate(TIES)]
    return spark.createDataFrame(
        rows, "run_name string, split string, n_samples long, rgb_mse double, rgb_psnr double, rgb_ssim double, range_mse double, "
        "range_psnr double, range_depth_mae_m double, range_valid_frac double",
    )


def test_comparison_rounds_halves_to_even(spark):
    table = spark.createDataFrame(
        [(k, f"r{k}", "m", 1, v, None, "cpu") for k, v in enumerate(TIES)],
        "run_order long, run_name string, model string, epochs int, final_train_loss double, final_val_loss double, backend string",
    )
    got = runs.comparison(table, _evals(spark)).orderBy("run_order").collect()
    for r, text in zip(got, TIES.values()):
        assert (r.final_train_loss, r.rgb_mse, r.range_psnr, r.range_valid_frac) == (text,) * 4


def test_report_rows_round_halves_to_even(spark):
    got = {(r.run_name, r.modality): r for r in runs.report_rows(_evals(spark)).collect()}
    for k, text in enumerate(TIES.values()):
        assert got[f"r{k}", "RGB"].mean_ssim == text and got[f"r{k}", "Range"].mean_depth_mae_m == text


def test_summary_lines_round_halves_to_even(spark):
    means = "struct<mean_mse:double,mean_mae:double,mean_rmse:double,mean_psnr_db:double,mean_ssim:double,std_mse:double>"
    depth = "struct<mean_mae_m:double,mean_rmse_m:double,mean_d125:double,mean_d125_sq:double,mean_valid_fraction:double>"
    df = spark.createDataFrame([("val", 3, (0.6953125, 0.0078125, 83.8515625, None, None, 0.0234375), None, None)], f"split string, n_samples long, rgb {means}, range {means}, depth {depth}")
    line = writers.eval_summary_rows(df).collect()[0].line
    assert line.split(" | ")[1:4] == ["0.695312", "0.007812", "83.851562"] and line.endswith("| 0.023438 |")
