"""Queries on scores, counts and embeddings: ranking metrics, constant and projection baselines, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.functions.arrays import digest
from framewise.operators import baselines, probe, ranking
from framewise.plans import views
from framewise.plans.registry import Registry, r6
from framewise.plans.tensor_ops import digest_sql

reg = Registry()

SCORES = """sc AS (SELECT c.class, doc_id AS idx, c.label, round(n_chars / (n_chars + 2000)::DOUBLE, 2) AS score
  FROM documents JOIN labels USING (doc_id), LATERAL (VALUES ('quality', quality), ('toxic', toxic), ('never', 0)) c(class, label))"""
AP = f"""ap AS (SELECT class, 'average precision' AS metric, avg(hits / rn) FILTER (label = 1) AS value FROM (SELECT *,
  row_number() OVER (PARTITION BY class ORDER BY score DESC, idx)::DOUBLE AS rn, sum(label) OVER (PARTITION BY class ORDER BY score DESC, idx) AS hits FROM sc) GROUP BY 1)"""
AU = f"""au AS (SELECT class, 'auroc' AS metric, (sum(label * r) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS value FROM
  (SELECT class, label, avg(rn) OVER (PARTITION BY class, score) AS r FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score)::DOUBLE AS rn FROM sc)) GROUP BY 1)"""
TH = """th AS (SELECT class, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
  count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM sc GROUP BY 1),
  thm AS (SELECT *, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1,
    (tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS ba FROM th)"""
ALL = f"""{SCORES}, {AP}, {AU}, {TH}, every AS (SELECT * FROM ap UNION ALL SELECT * FROM au UNION ALL SELECT class, 'f1', f1 FROM thm UNION ALL SELECT class, 'balanced accuracy', ba FROM thm)"""


def scores(spark, d):
    return views.scores(views.table(spark, d, "documents"), views.table(spark, d, "labels"))


def rows(spark, d):
    return views.probe_rows(views.array_table(spark, d, "embeddings", "vec_id"))


@reg.add("average_precision", f"WITH {SCORES}, {AP} SELECT class, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'requires at least one positive label' END AS na_reason FROM ap")
def average_precision(spark, d):
    return ranking.average_precision(scores(spark, d)).select("class", r6("value"), "na_reason")


@reg.add("auroc", f"WITH {SCORES}, {AU} SELECT class, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'requires both positive and negative labels' END AS na_reason FROM au")
def auroc(spark, d):
    return ranking.auroc(scores(spark, d)).select("class", r6("value"), "na_reason")


@reg.add("threshold_metrics", f"WITH {SCORES}, {TH} SELECT class, tp, tn, fp, fn, round(f1, 6) AS f1, round(ba, 6) AS balanced_accuracy FROM thm")
def threshold_metrics(spark, d):
    return ranking.threshold_metrics(scores(spark, d)).select("class", "tp", "tn", "fp", "fn", r6("f1"), r6("balanced_accuracy"))


@reg.add("classification_per_class", f"WITH {ALL} SELECT class, metric, round(value, 6) AS value, value IS NULL AS undefined FROM every")
def classification_per_class(spark, d):
    return ranking.per_class(scores(spark, d)).select("class", "metric", r6("value"), F.col("na_reason").isNotNull().alias("undefined"))


@reg.add("classification_macro", f"WITH {ALL} SELECT metric, round(avg(value), 6) AS value, NULL::VARCHAR AS na_reason FROM every GROUP BY 1")
def classification_macro(spark, d):
    return ranking.classification(scores(spark, d)).select("metric", r6("value"), "na_reason")


@reg.add(
    "macro_undefined",
    f"""WITH {ALL} SELECT metric, round(avg(value), 6) AS value, CASE WHEN avg(value) IS NULL THEN 'all ' || metric || ' values are undefined' END AS na_reason
    FROM every WHERE class = 'never' GROUP BY 1""",
)
def macro_undefined(spark, d):
    return ranking.macro(ranking.per_class(scores(spark, d)).where("class = 'never'")).select("metric", r6("value"), "na_reason")


COUNTED = """cr AS (SELECT l_returnflag AS target, l_quantity - 3 AS truth, ln(1 + l_quantity) * (1 - l_discount) - 1 AS pred_log FROM lineitem UNION ALL SELECT 'flat', 2.0, l_tax FROM lineitem),
  cw AS (SELECT target, greatest(truth, 0) AS t, greatest(exp(pred_log) - 1, 0) AS p FROM cr),
  cm AS (SELECT target, avg(t) AS m FROM cw GROUP BY 1),
  cs AS (SELECT target, avg(abs(t - p)) AS mae, sqrt(avg((t - p) * (t - p))) AS rmse, 1 - sum((t - p) * (t - p)) / nullif(sum((t - m) * (t - m)), 0) AS r2 FROM cw JOIN cm USING (target) GROUP BY 1)"""


@reg.add(
    "regression_metrics",
    f"""WITH {COUNTED} SELECT target, metric, round(value, 5) AS value, CASE WHEN value IS NULL THEN 'target variance is zero' END AS na_reason FROM
    (SELECT target, 'mae' AS metric, mae AS value FROM cs UNION ALL SELECT target, 'rmse', rmse FROM cs UNION ALL SELECT target, 'r2', r2 FROM cs)""",
)
def regression_metrics(spark, d):
    li = views.table(spark, d, "lineitem")
    a = li.select(F.col("l_returnflag").alias("target"), (F.col("l_quantity") - 3).alias("truth"), (F.log1p("l_quantity") * (1 - F.col("l_discount")) - 1).alias("pred_log"))
    b = li.select(F.lit("flat").alias("target"), F.lit(2.0).alias("truth"), F.col("l_tax").alias("pred_log"))
    return ranking.regression(a.unionByName(b)).select("target", "metric", F.round("value", 5).alias("value"), "na_reason")


PROBE = """pr AS (SELECT vec_id AS idx, label, CASE vec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'eval' ELSE 'train' END AS part, embedding FROM embeddings)"""
PRES = f"""{PROBE}, ps AS (SELECT part, idx, 'class_' || k AS class, (label = k)::INT AS y FROM pr, range(10) r(k)),
  pri AS (SELECT class, avg(y) AS prior FROM ps WHERE part = 'train' GROUP BY 1)"""
CLIP = "greatest(least(prior, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)"


@reg.add(
    "standardized_features",
    f"""WITH {PROBE}, f AS (SELECT part, idx, k, embedding[k]::DOUBLE AS v FROM pr, range(1, 65) r(k)),
    s AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) <= 1e-6 THEN 1 ELSE stddev_pop(v) END AS sd FROM f WHERE part = 'train' GROUP BY 1)
    SELECT idx, part, len(z) AS n, round(list_sum(z), 6) + 0.0 AS total, round(list_sum(list_transform(z, lambda e, i: e * i)), 5) + 0.0 AS weighted
    FROM (SELECT idx, part, list((v - m) / sd ORDER BY k) AS z FROM f JOIN s USING (k) GROUP BY 1, 2)""",
)
def standardized_features(spark, d):
    return baselines.standardize(rows(spark, d)).select("idx", "part", *digest(F.col("features")))


@reg.add(
    "class_weights",
    f"""WITH {PRES}, w AS (SELECT class, 1 / greatest(least(prior, 0.95), 0.05) AS w FROM pri) SELECT class, round(w / avg(w) OVER (), 6) AS weight FROM w""",
)
def class_weights(spark, d):
    return baselines.class_weights(rows(spark, d)).select("class", r6("weight"))


@reg.add(
    "class_prior_baseline",
    f"""WITH {PRES}, j AS (SELECT part, class, idx, y, prior FROM ps JOIN pri USING (class) WHERE part <> 'val'),
    l AS (SELECT part, avg(-(y * ln({CLIP}) + (1 - y) * ln(1 - {CLIP}))) AS v FROM j GROUP BY 1),
    e AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY idx)::DOUBLE AS rn, sum(y) OVER (PARTITION BY class ORDER BY idx) AS hits FROM j WHERE part = 'eval'),
    c AS (SELECT class, avg(hits / rn) FILTER (y = 1) AS ap, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN 0.5 END AS au,
      CASE WHEN max(prior) >= 0.5 THEN 2.0 * sum(y) / (count(*) + sum(y)) WHEN sum(y) > 0 THEN 0.0 END AS f1 FROM e GROUP BY 1)
    SELECT part || '_loss' AS metric, round(v, 6) AS value FROM l
    UNION ALL SELECT 'average precision', round(avg(ap), 6) FROM c UNION ALL SELECT 'auroc', round(avg(au), 6) FROM c
    UNION ALL SELECT 'balanced accuracy', round(avg(au), 6) FROM c UNION ALL SELECT 'f1', round(avg(f1), 6) FROM c""",
)
def class_prior_baseline(spark, d):
    return baselines.class_prior(rows(spark, d)).select("metric", r6("value"))


def _count_sql(fit: str, huber: bool) -> str:
    loss = "CASE WHEN abs(z) <= 1 THEN 0.5 * z * z ELSE abs(z) - 0.5 END" if huber else "z * z"
    return f"""WITH {PROBE}, cn AS (SELECT part, idx, 'count_0' AS target, label::DOUBLE AS y FROM pr UNION ALL SELECT part, idx, 'count_1', (idx % 7)::DOUBLE FROM pr),
    k AS (SELECT target, {fit} AS lg FROM cn WHERE part = 'train' GROUP BY 1),
    j AS (SELECT part, target, y, lg, lg - ln(1 + y) AS z, exp(lg) - 1 AS p FROM cn JOIN k USING (target) WHERE part <> 'val'),
    m AS (SELECT target, avg(y) AS ym FROM j WHERE part = 'eval' GROUP BY 1),
    s AS (SELECT target, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)) AS r2 FROM j JOIN m USING (target) WHERE part = 'eval' GROUP BY 1)
    SELECT part || '_loss' AS metric, round(avg({loss}), 6) AS value FROM j GROUP BY part
    UNION ALL SELECT 'mae', round(avg(mae), 6) FROM s UNION ALL SELECT 'rmse', round(avg(rmse), 6) FROM s UNION ALL SELECT 'r2', round(avg(r2), 6) FROM s"""


@reg.add("count_mean_baseline", _count_sql("ln(1 + avg(y))", True))
def count_mean_baseline(spark, d):
    return baselines.count_mean(rows(spark, d), "count-mean").select("metric", r6("value"))


@reg.add("log1p_mean_baseline", _count_sql("avg(ln(1 + y))", False))
def log1p_mean_baseline(spark, d):
    return baselines.count_mean(rows(spark, d), "log1p-mean", loss="mse").select("metric", r6("value"))


K, SEED = 8, 7


def _signs_sql() -> str:
    """The same sign stream as a recursive-free formula on 64-bit unsigned integers."""
    two64 = "18446744073709551616::UHUGEINT"
    start = SEED ^ baselines.PROJECTION_SALT

    def mul(x: str, k: int) -> str:
        # split the product so that it stays inside 128 bits
        return f"((({x}::UHUGEINT % 4294967296::UHUGEINT) * {k}::UHUGEINT + ((({x}::UHUGEINT // 4294967296::UHUGEINT) * {k}::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % {two64})::UBIGINT"

    s0 = f"(({start}::UHUGEINT + (n::UHUGEINT * {baselines.GOLDEN_GAMMA}::UHUGEINT) % {two64}) % {two64})::UBIGINT"
    return f"""z0 AS (SELECT n, {s0} AS z FROM range(1, {64 * K + 1}) r(n)),
      z1 AS (SELECT n, {mul('xor(z, z >> 30)', baselines.MIX_1)} AS z FROM z0),
      z2 AS (SELECT n, {mul('xor(z, z >> 27)', baselines.MIX_2)} AS z FROM z1),
      sg AS (SELECT (n - 1) // {K} + 1 AS i, (n - 1) % {K} AS j, CASE WHEN xor(z, z >> 31) % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE / sqrt({K}::DOUBLE) AS w FROM z2)"""


@reg.add(
    "random_projection",
    f"""WITH {_signs_sql()}, f AS (SELECT vec_id AS idx, j, sum(embedding[i]::DOUBLE * w) AS v FROM embeddings, sg GROUP BY ALL),
    p AS (SELECT idx, list(v ORDER BY j) AS v FROM f GROUP BY 1) SELECT idx, {digest_sql('v')} FROM p""",
)
def random_projection(spark, d):
    return baselines.random_projection(rows(spark, d), K, SEED).select("idx", *digest(F.col("features")))


@reg.add(
    "pca_projection",
    """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 5 < 3), f AS (SELECT k, v[k]::DOUBLE AS x FROM e, range(1, 65) r(k)),
    t AS (SELECT sum(var_pop) AS total FROM (SELECT k, var_pop(x) AS var_pop FROM f GROUP BY 1))
    SELECT 64 AS width, true AS uncorrelated, true AS descending, round(total, 6) AS total_variance, true AS centred FROM t""",
)
def pca_projection(spark, d):
    """All 64 components keep the whole variance, are uncorrelated, ordered and centred on train."""
    out = baselines.pca(rows(spark, d), 64).where("part = 'train'")
    var = [F.var_pop(F.get("features", F.lit(k))) for k in range(64)]
    stats = out.agg(
        F.max(F.size("features")).alias("width"), F.array(*var).alias("v"),
        F.array(*[F.abs(F.corr(F.get("features", F.lit(0)), F.get("features", F.lit(k)))) for k in (1, 2, 3, 10)]).alias("r"),
        F.array(*[F.abs(F.avg(F.get("features", F.lit(k)))) for k in (0, 1, 2)]).alias("m"),
    )
    return stats.select(
        "width", (F.array_max("r") < 1e-6).alias("uncorrelated"),
        F.forall(F.sequence(F.lit(0), F.lit(62)), lambda i: F.get("v", i) >= F.get("v", i + 1) - 1e-12).alias("descending"),
        r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), "total_variance"), (F.array_max("m") < 1e-6).alias("centred"),
    )


@reg.add("pca_components")
def pca_components(spark, d):
    return baselines.pca(rows(spark, d), 4).select("idx", "part", *digest(F.col("features")))


TWO = f"""{PROBE}, two AS (SELECT idx, part, label::DOUBLE AS y0, ln(1 + label) AS y, list_sum(list_transform(embedding, lambda e: e::DOUBLE)) AS a,
  list_sum(list_transform(embedding, lambda e, i: e::DOUBLE * i / 64)) AS b FROM pr)"""


def two_features(spark, d):
    """Two features that each take in the whole vector, so that fits have a closed form in SQL."""
    v = F.transform("features", lambda x: x.cast("double"))
    a = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    b = F.aggregate(F.transform(v, lambda x, i: x * (i + 1) / 64), F.lit(0.0), lambda s, x: s + x)
    return rows(spark, d).withColumn("features", F.array(a, b))


@reg.add(
    "ridge_probe",
    f"""WITH {TWO}, m AS (SELECT count(*) AS n, sum(a * a) + 0.05 * count(*) AS aa, sum(a * b) AS ab, sum(a) AS sa, sum(b * b) + 0.05 * count(*) AS bb, sum(b) AS sb,
      1.05 * count(*) AS nn, sum(a * y) AS ay, sum(b * y) AS by_, sum(y) AS sy FROM two WHERE part = 'train'),
    q AS (SELECT *, aa * (bb * nn - sb * sb) - ab * (ab * nn - sb * sa) + sa * (ab * sb - bb * sa) AS det FROM m),
    w AS (SELECT (ay * (bb * nn - sb * sb) - ab * (by_ * nn - sb * sy) + sa * (by_ * sb - bb * sy)) / det AS wa,
      (aa * (by_ * nn - sb * sy) - ay * (ab * nn - sb * sa) + sa * (ab * sy - by_ * sa)) / det AS wb,
      (aa * (bb * sy - by_ * sb) - ab * (ab * sy - by_ * sa) + ay * (ab * sb - bb * sa)) / det AS w0 FROM q)
    SELECT idx, part, round(wa * a + wb * b + w0, 4) + 0.0 AS pred_log FROM two, w WHERE part IN ('train', 'eval')""",
)
def ridge_probe(spark, d):
    """Squared loss on one target with penalty 0.1: the minimum solves three linear equations."""
    one = two_features(spark, d).withColumn("presence", F.lit(None).cast("array<tinyint>")).withColumn("counts", F.slice("counts", 1, 1))
    _, counts = probe.heads(one, probe.ProbeConfig(l2=0.1, standardize=False, loss="mse"))
    return counts.select("idx", "part", (F.round("pred_log", 4) + F.lit(0.0)).alias("pred_log"))


STEPS = 12


def _newton_sql(y: str, slope: str, bend: str, l2: float, out: str, squares_first: bool = False) -> str:
    """Newton steps for two features and a bias, one aggregate and a 3 x 3 system each; all weights are penalised.

    With ``squares_first`` the first step is that of the squared loss, from which undamped steps settle.
    """
    parts = [f"WITH {TWO}, tr AS (SELECT a, b, {y} AS t FROM two WHERE part = 'train'), w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc)"]
    for i in range(STEPS):
        g, h = ("z - t", "1") if squares_first and i == 0 else (slope, bend)
        parts.append(f"""r{i} AS (SELECT a, b, wa, wb, wc, wa * a + wb * b + wc AS z, t FROM tr, w{i}), s{i} AS (SELECT a, b, wa, wb, wc, {g} AS g, {h} AS h FROM r{i}),
          m{i} AS (SELECT any_value(wa) AS wa, any_value(wb) AS wb, any_value(wc) AS wc, avg(h * a * a) + {l2} AS aa, avg(h * a * b) AS ab, avg(h * a) AS ac, avg(h * b * b) + {l2} AS bb, avg(h * b) AS bc, avg(h) + {l2} AS cc,
            avg(g * a) + {l2} * any_value(wa) AS ga, avg(g * b) + {l2} * any_value(wb) AS gb, avg(g) + {l2} * any_value(wc) AS gc FROM s{i}),
          d{i} AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m{i}),
          w{i + 1} AS (SELECT wa - (ga * (bb * cc - bc * bc) - ab * (gb * cc - bc * gc) + ac * (gb * bc - bb * gc)) / det AS wa,
            wb - (aa * (gb * cc - bc * gc) - ga * (ab * cc - bc * ac) + ac * (ab * gc - gb * ac)) / det AS wb,
            wc - (aa * (bb * gc - gb * bc) - ab * (ab * gc - gb * ac) + ga * (ab * bc - bb * ac)) / det AS wc FROM d{i})""")
    return ", ".join(parts) + f" SELECT idx, part, round({out}, 5) + 0.0 AS value FROM two, w{STEPS} WHERE part IN ('train', 'eval')"


@reg.add(
    "logistic_probe",
    _newton_sql("(y0 < 5)::INT", "1 / (1 + exp(-z)) - t", "1 / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z)))", 0.01, "1 / (1 + exp(-(wa * a + wb * b + wc)))"),
)
def logistic_probe(spark, d):
    """A logistic head on two features, against fixed Newton steps."""
    one = two_features(spark, d).withColumn("presence", F.array(F.exists(F.slice("presence", 1, 5), lambda p: p == 1).cast("tinyint")))
    scores, _ = probe.heads(one.withColumn("counts", F.lit(None).cast("array<double>")), probe.ProbeConfig(l2=0.01, standardize=False, balance_classes=False))
    return scores.select("idx", "part", (F.round("score", 5) + F.lit(0.0)).alias("value"))


@reg.add(
    "huber_probe",
    _newton_sql("y", "least(greatest(z - t, -0.7), 0.7)", "(abs(z - t) <= 0.7)::INT", 0.05, "wa * a + wb * b + wc", squares_first=True),
)
def huber_probe(spark, d):
    """A Huber head on two features, against fixed Newton steps."""
    one = two_features(spark, d).withColumn("presence", F.lit(None).cast("array<tinyint>")).withColumn("counts", F.slice("counts", 1, 1))
    _, counts = probe.heads(one, probe.ProbeConfig(l2=0.05, standardize=False, huber_delta=0.7))
    return counts.select("idx", "part", (F.round("pred_log", 5) + F.lit(0.0)).alias("value"))


@reg.add(
    "pca_two_features",
    f"""WITH {TWO}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM two WHERE part = 'train'),
    e AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l1, (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l2 FROM m),
    v AS (SELECT ma, mb, ab / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS x1, (l1 - aa) / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS y1,
      ab / sqrt(ab * ab + (l2 - aa) * (l2 - aa)) AS x2, (l2 - aa) / sqrt(ab * ab + (l2 - aa) * (l2 - aa)) AS y2 FROM e),
    s AS (SELECT ma, mb, x1 * sign(CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) AS x1, y1 * sign(CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) AS y1,
      x2 * sign(CASE WHEN abs(x2) >= abs(y2) THEN x2 ELSE y2 END) AS x2, y2 * sign(CASE WHEN abs(x2) >= abs(y2) THEN x2 ELSE y2 END) AS y2 FROM v)
    SELECT idx, part, round((a - ma) * x1 + (b - mb) * y1, 5) + 0.0 AS first, round((a - ma) * x2 + (b - mb) * y2, 5) + 0.0 AS second FROM two, s""",
)
def pca_two_features(spark, d):
    out = baselines.pca(two_features(spark, d), 2)
    first, second = (F.round(F.get("features", F.lit(k)), 5) + F.lit(0.0) for k in (0, 1))
    return out.select("idx", "part", first.alias("first"), second.alias("second"))


@reg.add("linear_probe")
def linear_probe(spark, d):
    return probe.linear(rows(spark, d))


@reg.add("linear_probe_on_projection")
def linear_probe_on_projection(spark, d):
    return probe.linear(baselines.random_projection(rows(spark, d), K, SEED))


@reg.add("l2_grid_selection")
def l2_grid_selection(spark, d):
    """All classes, counts and penalties are fitted in the same passes."""
    return probe.select_l2(rows(spark, d))


@reg.add("l2_winner_metrics")
def l2_winner_metrics(spark, d):
    return probe.regularised(rows(spark, d))


@reg.add(
    "l2_pick",
    """WITH c AS (SELECT l_discount AS l2, round(avg(l_quantity), 1) AS s FROM lineitem GROUP BY 1)
    SELECT min(l2) AS selected_l2, max(s) AS validation_score FROM c WHERE s = (SELECT max(s) FROM c)""",
)
def l2_pick(spark, d):
    grid = views.table(spark, d, "lineitem").groupBy(F.col("l_discount").alias("l2")).agg(F.round(F.avg("l_quantity"), 1).alias("validation_score"))
    return probe.pick_l2(grid)
