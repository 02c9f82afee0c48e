import math

import pytest
from pyspark.sql import functions as F

from framewise.operators import evaluate, ranking, ratedist, runs
from framewise.sinks import writers

MOD = "struct<mse:double,mae:double,rmse:double,psnr_db:double,ssim:double>"
DEPTH = "struct<mae_m:double,rmse_m:double,d125:double,d125_sq:double,valid_fraction:double>"
SCHEMA = f"sample_id string, split string, rgb {MOD}, range {MOD}, depth {DEPTH}"


def test_split_summary_golden(spark):
    rows = [
        ("a", "val", (1.0, 1.0, 1.0, 10.0, 0.4), None, (1.0, 2.0, 0.25, 0.5, 0.4)),
        ("b", "val", (3.0, 3.0, 3.0, 20.0, 0.8), None, (3.0, 4.0, 0.5, 0.75, 0.8)),
        ("c", "val", None, None, (None, None, None, None, 0.6)),
    ]
    out = evaluate.summarize(spark.createDataFrame(rows, SCHEMA)).first()
    assert out["n_samples"] == 3 and out["range"] is None
    assert (out["rgb"]["mean_mse"], out["rgb"]["mean_psnr_db"], out["rgb"]["std_mse"]) == (2.0, 15.0, 1.0)
    assert math.isclose(out["rgb"]["mean_ssim"], 0.6)
    assert (out["depth"]["mean_mae_m"], out["depth"]["mean_rmse_m"], out["depth"]["mean_d125"]) == (2.0, 3.0, 0.375)
    assert math.isclose(out["depth"]["mean_valid_fraction"], 0.6)


def test_combined_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "mse double, psnr_db double, ssim double")
    out = evaluate.combine(empty).first()
    assert (out["mse"], out["psnr_db"], out["ssim"]) == (0.0, 0.0, None)


def test_csv_row_golden(spark, tmp_path):
    rows = [
        (
            'sample-1', "val", (0.25, 0.5, 0.5, float("inf"), 0.9876543), (1.5, 1.25, 1.2247449, 7.5, None), (None, 0.5, 0.75, 0.9, 1.0),
        ),
        ('a,"b"', "val", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    writers.write_eval_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == ",".join(writers.EVAL_CSV_COLUMNS)
    assert text[1] == "sample-1,0.25,0.5,0.5,inf,0.9876543,1.5,1.25,1.2247449,7.5,,7.5,,,0.5,0.75,0.9,1"
    assert text[2] == '"a,""b"""' + "," * 17


def test_metric_text_never_uses_exponents(spark):
    values = [(1e-4,), (1.5e-7,), (2e7,), (1.25,), (3.0,), (0.0,), (-0.0005,), (None,), (float("inf"),)]
    df = spark.createDataFrame(values, "v double")
    got = [r[0] for r in df.select(writers.metric_text(F.col("v"))).collect()]
    assert got == ["0.0001", "0.00000015", "20000000", "1.25", "3", "0", "-0.0005", None, "inf"]


def test_metric_text_of_both_paths(spark):
    texts = {
        -0.0: "-0", 1e-3: "0.001", 0.00099: "0.00099", 9999999.0: "9999999", 1e7: "10000000", -12.0: "-12", 8388607.5: "8388607.5", 0.1: "0.1",
        1.00000001: "1", -1e7: "-10000000", 1e20: "100000000000000000000",
    }
    df = spark.createDataFrame([(v,) for v in texts], "v double")
    assert [r[0] for r in df.select(writers.metric_text(F.col("v"))).collect()] == list(texts.values())


def test_csv_rows_run_compiled(spark):
    """The JVM leaves methods of over 8000 bytes of code to its interpreter."""
    stages = writers.eval_csv_rows(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes, default=0) <= 8000


def scores(spark, cls, labels, values):
    rows = [(cls, i, int(l), float(s)) for i, (l, s) in enumerate(zip(labels, values))]
    return spark.createDataFrame(rows, "class string, idx bigint, label int, score double")


def test_ranking_metrics_small(spark):
    df = scores(spark, "a", [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    assert math.isclose(ranking.average_precision(df).first()["value"], (1 + 2 / 3) / 2)
    assert ranking.auroc(df).first()["value"] == 0.75
    flat = scores(spark, "a", [1, 0, 1, 0], [0.5] * 4)
    assert ranking.auroc(flat).first()["value"] == 0.5
    only = ranking.auroc(scores(spark, "a", [1, 1], [0.2, 0.9])).first()
    assert only["value"] is None and only["na_reason"] == ranking.NO_CONTRAST
    none = ranking.threshold_metrics(scores(spark, "a", [0, 0], [0.1, 0.2])).first()
    assert none["f1"] is None and none["f1_na_reason"] == ranking.NO_F1
    with pytest.raises(Exception, match="finite"):
        ranking.check_scores(scores(spark, "a", [1], [1.5])).collect()


def test_regression_overflow_and_flat_targets(spark):
    rows = [("a", 1.0, 1000.0), ("a", 1.0, 0.0)]
    out = {r["metric"]: r for r in ranking.regression(spark.createDataFrame(rows, "target string, truth double, pred_log double")).collect()}
    assert out["r2"]["value"] is None and out["r2"]["na_reason"] == ranking.NO_VARIANCE
    assert out["mae"]["value"] > 1e300


def points(spark, pts, curve="c"):
    return spark.createDataFrame([(curve, i, float(r), float(p)) for i, (r, p) in enumerate(pts)], "curve string, idx bigint, rate double, psnr_db double")


def test_frontier_golden(spark):
    pts = [(100, 30), (250, 34), (100, 31), (300, 33), (400, 36), (500, 36)]
    front = ratedist.frontier(points(spark, pts)).orderBy("rate").collect()
    assert [(r["rate"], r["psnr_db"]) for r in front] == [(100.0, 31.0), (250.0, 34.0), (400.0, 36.0)]
    got = ratedist.rate_at(points(spark, pts), [35.0]).first()["rate"]
    assert math.isclose(got, math.sqrt(250 * 400))


def test_close_rates_merge(spark):
    pts = [(1.0, 30), (1.0 + 1e-13, 31), (2.0, 31.0 + 5e-10), (3.0, 40)]
    front = ratedist.frontier(points(spark, pts)).orderBy("rate").collect()
    assert [(r["rate"], r["psnr_db"]) for r in front] == [(1.0, 31.0), (3.0, 40.0)]


def test_rate_at_edges(spark):
    curves = {"two": [(1, 30), (4, 40)], "edge": [(100, 30), (200, 35)], "lone": [(1, 30)]}
    every = None
    for name, pts in curves.items():
        one = points(spark, pts, name)
        every = one if every is None else every.unionByName(one)
    rows = ratedist.rate_at(every, [25.0, 30.0, 35.0, 40.0, float("nan")]).collect()
    got = {(r["curve"], r["target"]): r for r in rows if r["target"] == r["target"]}
    assert math.isclose(got["two", 35.0]["rate"], 2.0)
    assert got["edge", 40.0]["reason"] and got["edge", 25.0]["reason"] and got["edge", 40.0]["rate"] is None
    assert got["edge", 30.0]["rate"] == 100 and got["edge", 35.0]["rate"] == 200
    assert got["lone", 30.0]["reason"] == "not enough points: 1"
    assert {r["reason"] for r in rows if r["target"] != r["target"]} == {"target is not finite"}
    with pytest.raises(Exception, match="invalid rate-distortion point"):
        ratedist.rate_at(points(spark, [(-1, 30), (2, 31)]), [30.5]).collect()


def test_matched_targets_and_bpp(spark):
    assert ratedist.matched_targets(30.0, 30.00001) == [30.0] and ratedist.matched_targets(30.0, 29.0) == [30.0, 29.0]
    df = spark.createDataFrame([(100, 2)], "b bigint, n bigint")
    assert df.select(ratedist.bpp(F.col("b"), F.col("n"), 50).alias("r")).first()["r"] == 8.0
    with pytest.raises(ValueError):
        ratedist.bpp(F.col("b"), F.col("n"), 0)


def test_constant_payload_compresses(spark):
    df = spark.createDataFrame([(1, [0.5] * 4096)], "id int, embedding array<float>")
    row = ratedist.payload_sizes(df, keep=("id",)).first()
    assert row["payload_bytes"] == 22 + 4096 and row["raw_bytes"] == 4 * 4096


def test_curve_buckets(spark):
    rows = [("up", 10 * i, float(i)) for i in range(20)] + [("flat", i, 2.0) for i in range(3)] + [("one", 5, 1.0)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, loss double")
    got = {r["run"]: r["buckets"] for r in runs.curve_buckets(df, ["run"]).collect()}
    assert got["flat"] == [0] * 10 and got["one"] == [0] * 10
    spots = [math.floor(i * 19 / 9 + 0.5) for i in range(10)]
    assert got["up"] == [math.floor(s / 19 * 7 + 0.5) for s in spots]


def test_run_index_upsert_and_ci(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "run_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "run_id string, v int")
    assert sorted(tuple(r) for r in runs.upsert(old, new, order="v").collect()) == [("a", 1), ("b", 3), ("c", 2)]
    ci = runs.seed_ci(spark.createDataFrame([("m", 1.0), ("m", 3.0)], "k string, value double"), ["k"]).first()
    assert (ci["mean"], ci["lo"], ci["hi"], ci["n_seeds"]) == (2.0, 1.0, 3.0, 2)


def test_close_rates_are_compared_with_the_kept_one(spark):
    points = [("c", 1.0, 10.0), ("c", 1.0 + 0.9e-12, 11.0), ("c", 1.0 + 1.8e-12, 12.0), ("c", 2.0, 20.0)]
    front = ratedist.frontier(spark.createDataFrame(points, "curve string, rate double, psnr_db double")).orderBy("rate").collect()
    assert [(r["rate"], r["psnr_db"]) for r in front] == [(1.0, 11.0), (1.0 + 1.8e-12, 12.0), (2.0, 20.0)]
