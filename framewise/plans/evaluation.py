"""Queries on predictions: per-sample metrics, split summaries and their text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.functions.metrics import depth_metrics, error_metrics, ssim
from framewise.operators import evaluate, partials, ratedist
from framewise.plans import views
from framewise.plans.registry import Registry, finite_or_null, r6
from framewise.plans.tensor_ops import X, emb
from framewise.sinks import writers

reg = Registry()

HAT = f"""{X}, t AS (SELECT vec_id, x, list_transform(x, lambda e, i: CASE WHEN vec_id % 7 = 0 THEN e ELSE e + sin(i - 1) * 0.05 END) AS h,
  CASE vec_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM x)"""


def errors_sql(p: str, t: str) -> str:
    """mse, mae of two lists."""
    return (f"list_avg(list_transform(list_zip({p}, {t}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
            f"list_avg(list_transform(list_zip({p}, {t}), lambda z: abs(z[1] - z[2])))")


def luma_sql(v: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: 0.299 * {v}[i] + 0.587 * {v}[i + {n}] + 0.114 * {v}[i + {2 * n}])"


def ssim_sql(src: str, p: str, t: str, n: int, key: str = "vec_id") -> str:
    """Single-window similarity of planar RGB lists."""
    return f"""(SELECT {key}, ((2 * mx * my + 1e-4) * (2 * (xy - mx * my) + 9e-4)) / ((mx * mx + my * my + 1e-4) * (xx - mx * mx + yy - my * my + 9e-4)) AS ssim
      FROM (SELECT {key}, list_avg(lx) AS mx, list_avg(ly) AS my, list_avg(list_transform(lx, lambda a: a * a)) AS xx,
      list_avg(list_transform(ly, lambda a: a * a)) AS yy, list_avg(list_transform(list_zip(lx, ly), lambda z: z[1] * z[2])) AS xy
      FROM (SELECT {key}, {luma_sql(p, n)} AS lx, {luma_sql(t, n)} AS ly FROM {src})))"""


def psnr_sql(mse: str) -> str:
    return f"CASE WHEN {mse} = 0 THEN NULL ELSE 10 * log10(1 / {mse}) END"


def tens(spark, d):
    return views.tensors(emb(spark, d))


MSE, MAE = errors_sql("h", "x")


@reg.add(
    "error_metrics",
    f"""WITH {HAT}, m AS (SELECT vec_id, {MSE} AS mse, {MAE} AS mae FROM t WHERE vec_id % 13 <> 0)
    SELECT vec_id, round(mse, 8) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, round({psnr_sql('mse')}, 6) AS psnr_db, mse = 0 AS perfect FROM m""",
)
def error_metrics_query(spark, d):
    m = tens(spark, d).where(F.col("range_hat").isNotNull()).select("vec_id", error_metrics(F.col("range_hat"), F.col("range")).alias("m"))
    return m.select(
        "vec_id", F.round("m.mse", 8).alias("mse"), r6("m.mae", "mae"), r6("m.rmse", "rmse"),
        r6(finite_or_null(F.col("m.psnr_db")), "psnr_db"), (F.col("m.psnr_db") == F.lit(float("inf"))).alias("perfect"),
    )


def depth_sql(src: str, p: str, t: str, pixels: int, mask: str | None = None) -> str:
    """Aggregates of depth errors over unnested pixels."""
    valid = f"{t}[i] > 0" if mask is None else f"{mask}[i] > 0.5 AND {t}[i] > 0"
    ratio = "greatest(p / t, t / greatest(p, 1e-6))"
    return f"""(SELECT vec_id, avg(abs(p - t)) AS mae_m, sqrt(avg((p - t) * (p - t))) AS rmse_m, avg(({ratio} < 1.25)::INT) AS d125,
      avg(({ratio} < 1.5625)::INT) AS d125_sq, count(p) / {float(pixels)} AS valid_fraction
      FROM (SELECT vec_id, CASE WHEN {valid} THEN least(greatest({p}[i], 0), 1) * 75 END AS p, CASE WHEN {valid} THEN least(greatest({t}[i], 0), 1) * 75 END AS t
      FROM {src}, range(1, {pixels + 1}) r(i)) GROUP BY vec_id)"""


DEPTH_COLS = ("mae_m", "rmse_m", "d125", "d125_sq", "valid_fraction")
DEPTH_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in DEPTH_COLS)


@reg.add("depth_metrics", f"WITH {HAT}, s AS (SELECT * FROM t WHERE vec_id % 13 <> 0) SELECT vec_id, {DEPTH_ROUND} FROM {depth_sql('s', 'h', 'x', 64)}")
def depth_metrics_query(spark, d):
    m = tens(spark, d).where(F.col("range_hat").isNotNull()).select("vec_id", depth_metrics(F.col("range_hat"), F.col("range"), 64).alias("m"))
    return m.select("vec_id", *[r6(f"m.{c}", c) for c in DEPTH_COLS])


@reg.add(
    "depth_metrics_masked",
    f"WITH {HAT}, s AS (SELECT vec_id, h, x, x[33:64] AS mask FROM t WHERE vec_id % 13 <> 0) SELECT vec_id, {DEPTH_ROUND} FROM {depth_sql('s', 'h', 'x', 32, 'mask')}",
)
def depth_metrics_masked(spark, d):
    """The second plane is the validity channel."""
    m = tens(spark, d).where(F.col("range_hat").isNotNull()).select("vec_id", depth_metrics(F.col("range_hat"), F.col("range"), 32, 1).alias("m"))
    return m.select("vec_id", *[r6(f"m.{c}", c) for c in DEPTH_COLS])


@reg.add("ssim_single_window", f"WITH {HAT}, s AS (SELECT vec_id, h, x FROM t WHERE vec_id % 11 <> 0) SELECT vec_id, round(ssim, 6) AS ssim FROM {ssim_sql('s', 'h', 'x', 16)}")
def ssim_single_window(spark, d):
    rows = tens(spark, d).where(F.col("rgb_hat").isNotNull())
    return rows.select("vec_id", r6(ssim(F.col("rgb_hat"), F.col("rgb"), 4, 4), "ssim"))


@reg.add(
    "ssim_windows",
    f"""WITH {HAT}, l AS (SELECT vec_id, r, c, {' + '.join(f'{k} * h[(({p} * 192 + r * 16 + c) * 7) % 64 + 1]' for p, k in enumerate((0.299, 0.587, 0.114)))} AS a,
      {' + '.join(f'{k} * x[(({p} * 192 + r * 16 + c) * 7) % 64 + 1]' for p, k in enumerate((0.299, 0.587, 0.114)))} AS b
      FROM t, range(12) rr(r), range(16) cc(c) WHERE vec_id % 13 <> 0),
    w AS (SELECT vec_id, r0, c0, avg(a) AS mx, avg(b) AS my, avg(a * a) AS xx, avg(b * b) AS yy, avg(a * b) AS xy
      FROM l, (VALUES (0), (4)) s(r0), (VALUES (0), (4), (8)) u(c0) WHERE r BETWEEN r0 AND r0 + 7 AND c BETWEEN c0 AND c0 + 7 GROUP BY ALL)
    SELECT vec_id, round(avg(((2 * mx * my + 1e-4) * (2 * (xy - mx * my) + 9e-4)) / ((mx * mx + my * my + 1e-4) * (xx - mx * mx + yy - my * my + 9e-4))), 6) AS ssim
    FROM w GROUP BY vec_id""",
)
def ssim_windows(spark, d):
    """The vectors are sent, and the task tiles them."""
    rows = tens(spark, d).where(F.col("range_hat").isNotNull())
    return rows.select("vec_id", r6(ssim(F.col("range_hat"), F.col("x"), views.TILE_H, views.TILE_W, views.TILE), "ssim"))


@reg.add(
    "prediction_pairs",
    """SELECT vec_id, count(*) AS pairs FROM embeddings WHERE vec_id % 13 <> 0 GROUP BY 1""",
)
def prediction_pairs(spark, d):
    t = tens(spark, d)
    pred = t.where(F.col("range_hat").isNotNull()).select("sample_id", "range_hat")
    return evaluate.pair(pred, t.select("sample_id", "vec_id", "range")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("pairs"))


RMSE_, RMAE_ = errors_sql("h[1:32]", "x[1:32]")
GMSE, GMAE = errors_sql("h[1:48]", "x[1:48]")
SAMPLE = f"""{HAT}, e AS (SELECT t.vec_id, split, vec_id % 11 <> 0 AS has_rgb, vec_id % 13 <> 0 AS has_range,
    {GMSE} AS gm, {GMAE} AS ga, {RMSE_} AS rm, {RMAE_} AS ra FROM t),
  full_ AS (SELECT e.*, s.ssim, {', '.join(f'p.{c}' for c in DEPTH_COLS)} FROM e JOIN {ssim_sql('t', 'h', 'x', 16)} s USING (vec_id)
    JOIN {depth_sql('t', 'h', 'x', 32)} p USING (vec_id))"""
# perfect predictions are left out of PSNR means here so that means stay finite
SUMMARY_COLS = f"""count(*) AS n_samples,
  round(avg(gm) FILTER (has_rgb), 8) AS rgb_mse, round(avg(ga) FILTER (has_rgb), 6) AS rgb_mae, round(avg(sqrt(gm)) FILTER (has_rgb), 6) AS rgb_rmse,
  round(avg(10 * log10(1 / nullif(gm, 0))) FILTER (has_rgb), 6) AS rgb_psnr_db, round(avg(ssim) FILTER (has_rgb), 6) AS rgb_ssim,
  round(stddev_pop(gm) FILTER (has_rgb), 8) AS rgb_std,
  round(avg(rm) FILTER (has_range), 8) AS range_mse, round(avg(10 * log10(1 / nullif(rm, 0))) FILTER (has_range), 6) AS range_psnr_db,
  {', '.join(f'round(avg({c}) FILTER (has_range), 6) AS depth_{c}' for c in DEPTH_COLS)}"""


def sample_eval(spark, d):
    return evaluate.sample_metrics(tens(spark, d), (4, 4), (4, 8))


def split_means(spark, d, with_all: bool = False):
    return partials.split_means(tens(spark, d), (4, 4), (4, 8), with_all=with_all, finite=True)


def _summary_columns(out):
    return [
        "n_samples", F.round("rgb.mean_mse", 8).alias("rgb_mse"), r6("rgb.mean_mae", "rgb_mae"), r6("rgb.mean_rmse", "rgb_rmse"),
        r6("rgb.mean_psnr_db", "rgb_psnr_db"), r6("rgb.mean_ssim", "rgb_ssim"), F.round("rgb.std_mse", 8).alias("rgb_std"),
        F.round("range.mean_mse", 8).alias("range_mse"), r6("range.mean_psnr_db", "range_psnr_db"),
        *[r6(f"depth.mean_{c}", f"depth_{c}") for c in DEPTH_COLS],
    ]


@reg.add("split_summary", f"WITH {SAMPLE} SELECT split, {SUMMARY_COLS} FROM full_ GROUP BY split")
def split_summary(spark, d):
    out = split_means(spark, d)
    return out.select("split", *_summary_columns(out))


@reg.add(
    "split_summary_rollup",
    f"WITH {SAMPLE} SELECT split, {SUMMARY_COLS} FROM full_ GROUP BY split UNION ALL SELECT 'all', {SUMMARY_COLS} FROM full_",
)
def split_summary_rollup(spark, d):
    out = split_means(spark, d, with_all=True)
    return out.select("split", *_summary_columns(out))


@reg.add(
    "summary_with_infinity",
    f"""WITH {SAMPLE} SELECT split, bool_or(gm = 0) FILTER (has_rgb) AS rgb_infinite, bool_or(rm = 0) FILTER (has_range) AS range_infinite FROM full_ GROUP BY split""",
)
def summary_with_infinity(spark, d):
    """One perfect prediction makes the mean PSNR of its split infinite."""
    out = evaluate.summarize(sample_eval(spark, d))
    inf = F.lit(float("inf"))
    return out.select("split", (F.col("rgb.mean_psnr_db") == inf).alias("rgb_infinite"), (F.col("range.mean_psnr_db") == inf).alias("range_infinite"))


@reg.add(
    "combined_summary",
    f"""WITH {SAMPLE}, m AS (SELECT split, avg(gm) AS mse, avg(10 * log10(1 / nullif(gm, 0))) AS psnr_db, avg(ssim) AS ssim FROM full_ WHERE has_rgb GROUP BY 1
      UNION ALL SELECT split, avg(rm), avg(10 * log10(1 / nullif(rm, 0))), NULL FROM full_ WHERE has_range GROUP BY 1)
    SELECT split, round(avg(mse), 8) AS mse, round(avg(psnr_db), 6) AS psnr_db, round(avg(ssim), 6) AS ssim FROM m GROUP BY 1""",
)
def combined_summary(spark, d):
    rows = evaluate.modality_rows(split_means(spark, d))
    out = evaluate.combine(rows, ["split"])
    return out.select("split", F.round("mse", 8).alias("mse"), r6("psnr_db"), r6("ssim"))


def _psnr_sql(mse: str) -> str:
    return f"round(10 * log10(1 / nullif({mse}, 0)), 6)"


@reg.add(
    "evaluate_predictions",
    f"""WITH {SAMPLE}, g AS (SELECT *, CASE WHEN has_rgb THEN gm END AS g1, CASE WHEN has_range THEN rm END AS r1 FROM full_)
    SELECT printf('sample_%06d', vec_id) AS sample_id, split, round(g1, 8) AS rgb_mse, round(CASE WHEN has_rgb THEN ga END, 6) AS rgb_mae,
    round(sqrt(g1), 6) AS rgb_rmse, {_psnr_sql('g1')} AS rgb_psnr_db, round(CASE WHEN has_rgb THEN ssim END, 6) AS rgb_ssim, round(r1, 8) AS range_mse,
    round(CASE WHEN has_range THEN ra END, 6) AS range_mae, round(sqrt(r1), 6) AS range_rmse, {_psnr_sql('r1')} AS range_psnr_db,
    {', '.join(f'round(CASE WHEN has_range THEN {c} END, 6) AS depth_{c}' for c in DEPTH_COLS)} FROM g""",
)
def evaluate_predictions(spark, d):
    t = tens(spark, d)
    pred = t.select("sample_id", "rgb_hat", "range_hat")
    rows, _ = evaluate.evaluate(pred, t.select("sample_id", "split", "rgb", "range"), (4, 4), (4, 8))
    errors = [
        c for m in ("rgb", "range")
        for c in (
            F.round(f"{m}.mse", 8).alias(f"{m}_mse"), r6(f"{m}.mae", f"{m}_mae"), r6(f"{m}.rmse", f"{m}_rmse"),
            r6(finite_or_null(F.col(f"{m}.psnr_db")), f"{m}_psnr_db"),
        )
    ]
    return rows.select("sample_id", "split", *errors, r6("rgb.ssim", "rgb_ssim"), *[r6(f"depth.{c}", f"depth_{c}") for c in DEPTH_COLS])


def text_sql(v: str) -> str:
    """Quarter steps print the same shortest text everywhere."""
    return f"regexp_replace(({v})::VARCHAR, '[.]0$', '')"


@reg.add(
    "eval_csv_rows",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn, l_quantity / 4 AS q FROM lineitem)
    SELECT l_orderkey || ',' || l_linenumber AS sample_id,
    {', '.join(f"CASE WHEN l_linenumber <> 3 THEN {text_sql('q')} END AS rgb_{c}" for c in ('mse', 'mae', 'rmse'))},
    CASE WHEN l_linenumber = 3 THEN NULL WHEN q = 1 THEN 'inf' ELSE {text_sql('q * 2')} END AS rgb_psnr_db,
    {', '.join(f"{text_sql('q')} AS {c}" for c in ('range_mse', 'range_mae', 'range_rmse', 'range_depth_mae_m', 'range_depth_rmse_m', 'range_delta_lt_1_25_sq', 'range_valid_pixel_fraction'))},
    {', '.join(f"{text_sql('q + 0.5')} AS {c}" for c in ('range_psnr_db', 'range_proxy_psnr_db'))}, {text_sql('q / 8')} AS range_delta_lt_1_25,
    {', '.join(f"NULL::VARCHAR AS {c}" for c in ('rgb_ssim', 'range_ssim', 'range_proxy_ssim'))} FROM l""",
)
def eval_csv_rows(spark, d):
    q = F.col("l_quantity") / 4
    none = F.lit(None).cast("double")
    modality = lambda mse, psnr: F.struct(mse.alias("mse"), mse.alias("mae"), mse.alias("rmse"), psnr.alias("psnr_db"), none.alias("ssim"))
    rows = views.array_table(spark, d, "lineitem", "l_orderkey").select(
        F.concat_ws(",", "l_orderkey", "l_linenumber").alias("sample_id"),
        F.when(F.col("l_linenumber") != 3, modality(q, F.when(q == 1, F.lit(float("inf"))).otherwise(q * 2))).alias("rgb"),
        modality(q, q + 0.5).alias("range"),
        F.struct(q.alias("mae_m"), q.alias("rmse_m"), (q / 8).alias("d125"), q.alias("d125_sq"), q.alias("valid_fraction")).alias("depth"),
    )
    return writers.eval_csv_rows(rows)


@reg.add(
    "eval_markdown_rows",
    f"""WITH s AS (SELECT l_returnflag AS split, count(*) AS n_samples, max(l_quantity) / 4 AS m, min(l_quantity) / 4 AS k FROM lineitem GROUP BY 1)
    SELECT split, n_samples, 0 AS line_no, '| RGB | ' || printf('%.6f', m) || ' | ' || printf('%.6f', m) || ' | ' || printf('%.6f', m) || ' | ' || {text_sql('m * 2')} || ' | - | - | - | - | - | - | ' || printf('%.6f', k) || ' |' AS line FROM s
    UNION ALL SELECT split, n_samples, 1, '| Range | ' || printf('%.6f', m) || ' | ' || printf('%.6f', m) || ' | ' || printf('%.6f', m) || ' | inf | - | '
      || {text_sql('m')} || ' | - | ' || {text_sql('k')} || ' | ' || {text_sql('k')} || ' | ' || {text_sql('k')} || ' | ' || printf('%.6f', k) || ' |' FROM s WHERE split <> 'R'""",
)
def eval_markdown_rows(spark, d):
    none = F.lit(None).cast("double")
    m, k = F.col("m"), F.col("k")

    def means(psnr):
        return F.struct(m.alias("mean_mse"), m.alias("mean_mae"), m.alias("mean_rmse"), psnr.alias("mean_psnr_db"), none.alias("mean_ssim"), k.alias("std_mse"))

    depth = F.struct(m.alias("mean_mae_m"), none.alias("mean_rmse_m"), k.alias("mean_d125"), k.alias("mean_d125_sq"), k.alias("mean_valid_fraction"))
    s = views.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("split")).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.max("l_quantity") / 4).alias("m"), (F.min("l_quantity") / 4).alias("k")
    )
    summary = s.select(
        "split", "n_samples", means(m * 2).alias("rgb"), F.when(F.col("split") != "R", means(F.lit(float("inf")))).alias("range"),
        F.when(F.col("split") != "R", depth).alias("depth"),
    )
    return writers.eval_summary_rows(summary)


@reg.add(
    "label_artifact_rows",
    """SELECT printf('sample_%06d', doc_id) AS sample_id, quality, 4 AS n_classes, 'vehicle' AS first_benchmarkable FROM labels""",
)
def label_artifact_rows(spark, d):
    rows = views.table(spark, d, "labels").select(F.format_string("sample_%06d", "doc_id").alias("sample_id"), "quality")
    return writers.label_rows(rows).select(
        "sample_id", "quality", F.size("classes").alias("n_classes"), F.get("benchmarkable_classes", F.lit(0)).alias("first_benchmarkable")
    )


QSTEP = """qb AS (SELECT vec_id, embedding AS v, list_min(embedding) AS lo, list_max(embedding) AS hi, ((list_max(embedding) - list_min(embedding)) / 255::FLOAT)::FLOAT AS scale FROM embeddings),
  z AS (SELECT *, least(greatest(sign(q) * floor(abs(q) + 0.5), -128), 127)::INT AS zp FROM (SELECT *, ((-128)::FLOAT - (lo / scale)::FLOAT)::DOUBLE AS q FROM qb)),
  k AS (SELECT *, list_transform(v, lambda e: least(greatest(sign(((e / scale)::FLOAT + zp::FLOAT)::DOUBLE) * floor(abs(((e / scale)::FLOAT + zp::FLOAT)::DOUBLE) + 0.5), -128), 127)::INT) AS codes FROM z),
  p AS (SELECT vec_id, list_transform(v, lambda e: (e::DOUBLE + 1) / 2) AS t,
    list_transform(codes, lambda c: (least(greatest((c - zp)::FLOAT * scale, lo), hi)::DOUBLE + 1) / 2) AS q,
    list_transform(v, lambda e, i: (e::DOUBLE + 1) / 2 + sin(i - 1) * 0.05) AS r FROM k),
  u AS (SELECT vec_id, t, q, r, list_transform(t, lambda e: floor(least(greatest(e, 0), 1) * 255 + 0.5) / 255) AS tu,
    list_transform(q, lambda e: floor(least(greatest(e, 0), 1) * 255 + 0.5) / 255) AS qu,
    list_transform(r, lambda e: floor(least(greatest(e, 0), 1) * 255 + 0.5) / 255) AS ru FROM p)"""


def _op_sql(point: str, hat: str, size: int) -> str:
    parts = []
    for modality, n in (("rgb", 48), ("range", 64)):
        u_mse, _ = errors_sql(f"{hat}u[1:{n}]", f"tu[1:{n}]")
        f_mse, _ = errors_sql(f"{hat}[1:{n}]", f"t[1:{n}]")
        similarity = f"(SELECT avg(ssim) FROM {ssim_sql('u', hat + 'u', 'tu', 16)})" if modality == "rgb" else "NULL::DOUBLE"
        parts.append(
            f"""SELECT '{point}' AS point, '{modality}' AS modality, count(*) AS samples, (count(*) * {size})::BIGINT AS latent_bytes,
            avg(m) AS mse, avg(10 * log10(1 / m)) AS psnr_db, {similarity} AS ssim, avg(f) AS f32_mse, avg(10 * log10(1 / f)) AS f32_psnr_db
            FROM (SELECT {u_mse} AS m, {f_mse} AS f FROM u)"""
        )
    return " UNION ALL ".join(parts)


@reg.add(
    "operating_points",
    f"""WITH {QSTEP}, o AS ({_op_sql('raw_f32', 'r', 256)} UNION ALL {_op_sql('quantized', 'q', 86)}),
    a AS (SELECT * FROM o UNION ALL SELECT point, 'combined', max(samples), max(latent_bytes), avg(mse), avg(psnr_db), avg(ssim), avg(f32_mse), avg(f32_psnr_db) FROM o GROUP BY point)
    SELECT point, modality, samples, latent_bytes, round(mse, 8) AS mse, round(psnr_db, 5) AS psnr_db, round(ssim, 6) AS ssim,
    round(f32_mse, 8) AS f32_mse, round(f32_psnr_db, 5) AS f32_psnr_db, round(latent_bytes * 8.0::DOUBLE / (samples * 48), 6) AS rate_bpp FROM a""",
)
def operating_points(spark, d):
    return point_columns(points_of(spark, d))


def point_columns(points):
    return points.select(
        "point", "modality", "samples", "latent_bytes", F.round("mse", 8).alias("mse"), F.round("psnr_db", 5).alias("psnr_db"), r6("ssim"),
        F.round("f32_mse", 8).alias("f32_mse"), F.round("f32_psnr_db", 5).alias("f32_psnr_db"), r6("rate_bpp"),
    )


def point_vectors(spark, d):
    """``t``, its noisy copy ``r`` and ``q`` from the restored vectors."""
    unit = lambda c: F.transform(c, lambda e: (e.cast("double") + 1) / 2)
    q = ratedist.quantized(emb(spark, d))
    return q.select("vec_id", "embedding", unit(F.col("embedding")).alias("t"), unit(F.col("restored")).alias("q")).select(
        "vec_id", "embedding", "t", "q", F.transform("t", lambda v, i: v + F.sin(i.cast("double")) * 0.05).alias("r")
    )


def points_of(spark, d):
    """Raw reconstructions are noisy, quantised ones come from the restored vectors."""
    rows = point_vectors(spark, d)
    head = lambda c: F.slice(c, 1, 48)
    ready = rows.select(
        F.col("vec_id").alias("sample_id"), "embedding", head("t").alias("rgb"), F.col("t").alias("range"), head("r").alias("rgb_raw"),
        F.col("r").alias("range_raw"), head("q").alias("rgb_quant"), F.col("q").alias("range_quant"),
    )
    return ratedist.operating_points(ready, (4, 4), (4, 8))
