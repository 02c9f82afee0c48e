"""Queries on rate-distortion curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import ratedist
from framewise.plans import views
from framewise.plans.evaluation import QSTEP, _op_sql, points_of
from framewise.plans.registry import Registry, r6

reg = Registry()

TARGETS = [10.0, 20.0, 30.0, 45.0, 60.0, 49.5]
PTS = """pt AS (SELECT p_brand AS curve, p_partkey AS idx, p_retailprice AS rate, p_size::DOUBLE AS psnr_db FROM part),
  b AS (SELECT curve, rate, max(psnr_db) AS psnr_db FROM pt GROUP BY ALL),
  w AS (SELECT *, max(psnr_db) OVER (PARTITION BY curve ORDER BY rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b),
  f AS (SELECT curve, rate, psnr_db, lag(rate) OVER q AS previous_rate, lag(psnr_db) OVER q AS previous_psnr_db FROM w WHERE m IS NULL OR psnr_db > m + 1e-9
    WINDOW q AS (PARTITION BY curve ORDER BY rate))"""
TGT = f"tg AS (SELECT unnest({TARGETS}::DOUBLE[]) AS target)"
ENDS = "en AS (SELECT curve, count(*) AS points, min(psnr_db) AS lo, max(psnr_db) AS hi, min(rate) AS rlo, max(rate) AS rhi FROM f GROUP BY 1)"
RATED = f"""{PTS}, {TGT}, {ENDS}, ra AS (SELECT en.curve, target,
  CASE WHEN points < 2 THEN 'not enough points: ' || points WHEN target < lo - 1e-9 OR target > hi + 1e-9 THEN 'target outside the curve' END AS reason,
  CASE WHEN abs(target - lo) <= 1e-9 THEN rlo WHEN abs(target - hi) <= 1e-9 THEN rhi ELSE
    (SELECT exp(ln(previous_rate) + (target - previous_psnr_db) / (f.psnr_db - previous_psnr_db) * (ln(f.rate) - ln(previous_rate)))
     FROM f WHERE f.curve = en.curve AND target > previous_psnr_db AND target <= f.psnr_db) END AS rate FROM en, tg)"""
NEAR = f"""ne AS (SELECT curve, target, idx, rate, psnr_db FROM pt, tg QUALIFY row_number() OVER (PARTITION BY curve, target ORDER BY abs(psnr_db - target), rate, idx) = 1)"""


def points(spark, d):
    return views.rd_points(views.table(spark, d, "part"))


@reg.add("rd_frontier", f"WITH {PTS} SELECT curve, round(rate, 6) AS rate, psnr_db, round(previous_rate, 6) AS previous_rate, previous_psnr_db FROM f")
def rd_frontier(spark, d):
    return ratedist.frontier(points(spark, d)).select("curve", r6("rate"), "psnr_db", r6("previous_rate"), "previous_psnr_db")


@reg.add("rate_at_quality", f"WITH {RATED} SELECT curve, target, CASE WHEN reason IS NULL THEN round(rate, 6) END AS rate, reason FROM ra")
def rate_at_quality(spark, d):
    return ratedist.rate_at(points(spark, d), TARGETS).select("curve", "target", r6("rate"), "reason")


@reg.add("nearest_rd_point", f"WITH {PTS}, {TGT}, {NEAR} SELECT curve, target, idx, rate, psnr_db FROM ne")
def nearest_rd_point(spark, d):
    return ratedist.nearest(points(spark, d), TARGETS).select("curve", "target", "idx", "rate", "psnr_db")


@reg.add(
    "matched_quality",
    f"""WITH {RATED}, {NEAR} SELECT curve, target, CASE WHEN reason IS NULL THEN round(ra.rate, 6) END AS rate, ne.psnr_db AS nearest_psnr_db, ne.rate AS nearest_rate,
    'interp@psnr=' || printf('%.2f', target) AS quality_control, CASE WHEN reason IS NOT NULL THEN curve || ': ' || reason END AS note
    FROM ra JOIN ne USING (curve, target)""",
)
def matched_quality(spark, d):
    return ratedist.matched_quality(points(spark, d), TARGETS).withColumn("rate", r6("rate"))


@reg.add(
    "rd_summary_rows",
    f"""WITH {QSTEP}, o AS ({_op_sql('raw_f32', 'r', 256)} UNION ALL {_op_sql('quantized', 'q', 86)}),
    {RATED.replace(TGT, "tg AS (SELECT unnest([20.0, 40.0]::DOUBLE[]) AS target)")}, {NEAR}
    SELECT 'latent-' || point AS method, 'intra' AS mode, '-' AS quality, round(max(latent_bytes) * 8.0::DOUBLE / (max(samples) * 48), 6) AS rate_bpp,
      round(avg(psnr_db), 5) AS psnr_db, round(avg(mse), 8) AS mse FROM o GROUP BY point
    UNION ALL SELECT p_brand, p_type, p_size::VARCHAR, round(p_retailprice, 6), p_size, round(1.0::DOUBLE / (p_size + 1), 8) FROM part
    UNION ALL SELECT curve, 'matched', 'interp@psnr=' || printf('%.2f', target), round(ra.rate, 6), ne.psnr_db, NULL FROM ra JOIN ne USING (curve, target) WHERE reason IS NULL""",
)
def rd_summary_rows(spark, d):
    pts = points(spark, d)
    matched = ratedist.matched_quality(pts, [20.0, 40.0])
    out = ratedist.summary_rows(points_of(spark, d), pts, matched)
    return out.select("method", "mode", "quality", r6("rate_bpp"), F.round("psnr_db", 5).alias("psnr_db"), F.round("mse", 8).alias("mse"))


OWN = f"{QSTEP}, o AS ({_op_sql('raw_f32', 'r', 256)} UNION ALL {_op_sql('quantized', 'q', 86)})"
OWN_POINTS = "own AS (SELECT point, avg(psnr_db) AS p, max(latent_bytes) * 8.0::DOUBLE / (max(samples) * 48) AS b FROM o GROUP BY point)"


@reg.add(
    "matched_to_own_points",
    f"""WITH {OWN}, {OWN_POINTS}, {RATED.replace(TGT, "tg AS (SELECT p AS target FROM own WHERE point = 'raw_f32' OR abs(p - (SELECT p FROM own WHERE point = 'raw_f32')) > 1e-4)")}, {NEAR}
    SELECT curve, round(target, 5) AS target, CASE WHEN reason IS NULL THEN round(ra.rate, 4) END AS rate, ne.psnr_db AS nearest_psnr_db,
      'interp@psnr=' || printf('%.2f', target) AS quality_control, (SELECT round(b, 6) FROM own WHERE point = 'raw_f32') AS raw_rate_bpp,
      (SELECT round(p, 5) FROM own WHERE point = 'raw_f32') AS raw_psnr_db, (SELECT round(b, 6) FROM own WHERE point = 'quantized') AS quantized_rate_bpp,
      (SELECT round(p, 5) FROM own WHERE point = 'quantized') AS quantized_psnr_db FROM ra JOIN ne USING (curve, target)""",
)
def matched_to_own_points(spark, d):
    out = ratedist.matched_to(points_of(spark, d), points(spark, d))
    five = [F.round(c, 5).alias(c) for c in ("target", "raw_psnr_db", "quantized_psnr_db")]
    return out.select(
        "curve", *five, F.round("rate", 4).alias("rate"), "nearest_psnr_db", "quality_control", r6("raw_rate_bpp"), r6("quantized_rate_bpp")
    )


@reg.add(
    "rd_summary_own_points",
    f"""WITH {OWN}, {OWN_POINTS}, {RATED.replace(TGT, "tg AS (SELECT p AS target FROM own WHERE point = 'raw_f32' OR abs(p - (SELECT p FROM own WHERE point = 'raw_f32')) > 1e-4)")}, {NEAR}
    SELECT 'latent-' || point AS method, 'intra' AS mode, '-' AS quality, round(max(latent_bytes) * 8.0::DOUBLE / (max(samples) * 48), 4) AS rate_bpp,
      round(avg(psnr_db), 5) AS psnr_db, round(avg(mse), 8) AS mse FROM o GROUP BY point
    UNION ALL SELECT p_brand, p_type, p_size::VARCHAR, round(p_retailprice, 4), p_size, round(1.0::DOUBLE / (p_size + 1), 8) FROM part
    UNION ALL SELECT curve, 'matched', 'interp@psnr=' || printf('%.2f', target), round(ra.rate, 4), ne.psnr_db, NULL FROM ra JOIN ne USING (curve, target) WHERE reason IS NULL""",
)
def rd_summary_own_points(spark, d):
    """The summary at the quality that the raw and quantised points reach themselves."""
    own, pts = points_of(spark, d), points(spark, d)
    out = ratedist.summary_rows(own, pts, ratedist.matched_to(own, pts))
    return out.select("method", "mode", "quality", F.round("rate_bpp", 4).alias("rate_bpp"), F.round("psnr_db", 5).alias("psnr_db"), F.round("mse", 8).alias("mse"))
