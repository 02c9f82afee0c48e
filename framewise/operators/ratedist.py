"""Size accounting of quantised vectors and rate-distortion curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import int8
from framewise.operators import partials
from framewise.operators.evaluate import combine
from framewise.operators.ordered import PIECE, POSITION, first_per_key, pieces_of, running
from framewise.session import stage

RATE_EPS = 1e-12
PSNR_EPS = 1e-9


def quantized(df: DataFrame, col: str = "embedding", policy: str = "asymmetric") -> DataFrame:
    """Add ``meta, codes, restored`` to vectors."""
    return (
        df.withColumn("meta", int8.int8_meta(F.col(col), policy))
        .withColumn("codes", int8.quantize(F.col(col), F.col("meta")))
        .withColumn("restored", int8.dequantize(F.col("codes"), F.col("meta")))
    )


def payload_bytes(codes: Column) -> Column:
    """Serialised size: fixed header plus one byte per code."""
    return (F.size(codes) + int8.HEADER_BYTES).cast("bigint")


def raw_bytes(values: Column) -> Column:
    """Size of the vector as 32-bit floats."""
    return (F.size(values) * 4).cast("bigint")


def payload_sizes(df: DataFrame, col: str = "embedding", policy: str = "asymmetric", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with raw and payload bytes per vector."""
    return quantized(df, col, policy).select(
        *keep, raw_bytes(F.col(col)).alias("raw_bytes"), payload_bytes(F.col("codes")).alias("payload_bytes")
    )


def bpp(total_bytes: Column, samples: Column, pixels_per_sample: int) -> Column:
    """Bits per pixel; a zero denominator is an error."""
    if pixels_per_sample <= 0:
        raise ValueError("there is no pixel to spread the bytes over")
    pixels = samples * F.lit(pixels_per_sample)
    return F.when(pixels > 0, F.try_divide(total_bytes * 8.0, pixels.cast("double"))).otherwise(
        F.raise_error(F.lit("there is no pixel to spread the bytes over"))
    )


def operating_points(
    df: DataFrame, rgb_hw: tuple[int, int], range_hw: tuple[int, int], range_channels: int = 2, policy: str = "asymmetric",
    places: dict | None = None,
) -> DataFrame:
    """Raw and quantised points: bytes, bpp, modality and combined metrics in the 8-bit domain, and float notes.

    In: ``sample_id, embedding, rgb, range`` and reconstructions ``rgb_raw, range_raw, rgb_quant, range_quant``.
    Out: one row per point and modality, plus modality ``combined``. ``places`` as for ``partials.split_means``.
    """
    rgb_px, range_px = rgb_hw[0] * rgb_hw[1], range_hw[0] * range_hw[1]
    embedding = F.col("embedding")
    means = partials.point_means(df, rgb_hw, range_hw, range_channels, raw_bytes(embedding), int8.payload_size(embedding, policy), places)
    # four rows, staged because they are read three times below
    per_modality = stage(means.select("point", "modality", "samples", F.col("bytes").alias("latent_bytes"), *partials.POINT_METRICS))
    totals = per_modality.groupBy("point").agg(
        F.max("samples").alias("samples"), F.max("latent_bytes").alias("latent_bytes"),
        F.avg("f32_mse").alias("f32_mse"), F.avg("f32_psnr_db").alias("f32_psnr_db"), F.avg("f32_ssim").alias("f32_ssim"),
        F.avg("depth_mae_m").alias("depth_mae_m"),
    )
    both = combine(per_modality, ["point"]).join(totals, "point").withColumn("modality", F.lit("combined"))
    rate = bpp(F.col("latent_bytes"), F.col("samples"), rgb_px + range_px)
    return per_modality.unionByName(both.select(*per_modality.columns)).withColumn("rate_bpp", rate)


def check_points(points: DataFrame) -> DataFrame:
    """Rates must be finite and positive, PSNR finite; anything else raises with the point's index."""
    rate, psnr = F.col("rate").cast("double"), F.col("psnr_db").cast("double")
    inf = F.lit(float("inf"))
    bad = rate.isNull() | F.isnan(rate) | (rate <= 0) | (rate == inf) | psnr.isNull() | F.isnan(psnr) | (F.abs(psnr) == inf)
    where = F.coalesce(F.col("idx").cast("string"), F.lit("?")) if "idx" in points.columns else F.lit("?")
    return points.withColumn(
        "rate", F.when(bad, F.raise_error(F.concat(F.lit("invalid rate-distortion point "), where))).otherwise(rate)
    ).withColumn("psnr_db", psnr)


def frontier(points: DataFrame, by: str = "curve") -> DataFrame:
    """Rate-ordered points with strictly rising PSNR, and the previous frontier point of the curve.

    Equal rates keep their best PSNR; a point stays when it beats every cheaper point by more than 1e-9.
    """
    best = check_points(points).groupBy(by, "rate").agg(F.max("psnr_db").alias("psnr_db"))
    pieces = _merge_close_rates(pieces_of(best, [by], [F.col("rate")]), by)
    order = [F.col("rate")]
    ranked = running(pieces, [by], order, bucket=PIECE, max_before={"best_before": F.col("psnr_db")})
    kept = ranked.where(F.col("best_before").isNull() | (F.col("psnr_db") > F.col("best_before") + PSNR_EPS))
    linked = running(
        kept.select(by, "rate", "psnr_db", PIECE), [by], order, bucket=PIECE,
        max_before={"previous_rate": F.col("rate"), "previous_psnr_db": F.col("psnr_db")},
    )
    return linked.drop(PIECE)


def _merge_close_rates(pieces: DataFrame, by: str) -> DataFrame:
    """A rate within 1e-12 (relative) of the last rate that was kept counts as that one, with the better PSNR.

    Only rates that lie that close to the one before can be merged, and such neighbours are rare: one look at the
    ordered rates decides whether there are any, and only runs of them, a few doubles wide, are folded in order.
    """
    order = [F.col("rate")]
    near = _near(F.col("__prev"), F.col("rate"))
    step = running(pieces.drop(POSITION), [by], order, bucket=PIECE, max_before={"__prev": F.col("rate")})
    if step.where(near).isEmpty():
        return pieces.drop(POSITION)
    starts = F.when(F.col("__prev").isNull() | ~near, F.col("rate"))
    heads = running(stage(step), [by], order, bucket=PIECE, max_through={"__head": starts})
    run = F.sort_array(F.collect_list(F.struct("rate", "psnr_db")))
    folded = heads.groupBy(by, "__head").agg(_fold_close(run).alias("kept"), F.min(PIECE).alias(PIECE))
    return stage(folded.select(by, F.inline("kept"), PIECE))


def _near(kept: Column, rate: Column) -> Column:
    return rate - kept <= F.greatest(rate, F.lit(1.0)) * RATE_EPS


def _fold_close(run: Column) -> Column:
    """Rates in order to kept rates, each compared with the last kept one."""
    none = F.array().cast("array<struct<rate:double,psnr_db:double>>")

    def add(kept: Column, point: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        better = F.struct(last["rate"].alias("rate"), F.greatest(last["psnr_db"], point["psnr_db"]).alias("psnr_db"))
        joins = (F.size(kept) > 0) & _near(last["rate"], point["rate"])
        return F.when(joins, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(better))).otherwise(F.concat(kept, F.array(point)))

    return F.aggregate(run, none, add)


def _target_array(targets: list[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in targets])


def curve_ends(front: DataFrame, by: str = "curve") -> DataFrame:
    """Per curve: points and PSNR and rate at both ends."""
    return front.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("psnr_db").alias("min_psnr_db"), F.max("psnr_db").alias("max_psnr_db"),
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
    )


def rate_at(points: DataFrame, targets: list[float], by: str = "curve") -> DataFrame:
    """Rate of every curve at every target PSNR, linear in log rate; NULL with a reason outside the curve.

    Targets are a short literal list: each frontier segment looks up the ones inside it, so no join with them
    is needed. The frontier is read twice, so it is staged.
    """
    front = stage(frontier(points, by))
    low, high = F.col("previous_psnr_db"), F.col("psnr_db")
    inside = front.where(low.isNotNull()).select(
        by, "rate", "psnr_db", "previous_rate", "previous_psnr_db",
        F.explode(F.filter(_target_array(targets), lambda t: (t > low + PSNR_EPS) & (t <= high + PSNR_EPS))).alias("target"),
    )
    share = (F.col("target") - low) / (high - low)
    log_rate = F.ln("previous_rate") + share * (F.ln("rate") - F.ln("previous_rate"))
    # a target within eps above a knee matches two segments: the first one wins
    hits = inside.groupBy(by, "target").agg(F.min_by(F.exp(log_rate), F.col("psnr_db")).alias("between"))
    asked = curve_ends(front, by).withColumn("target", F.explode(_target_array(targets)))
    target, lo, hi = F.col("target"), F.col("min_psnr_db"), F.col("max_psnr_db")
    finite = ~F.isnan(target) & (F.abs(target) != F.lit(float("inf")))
    reason = (
        F.when(~finite, F.lit("target is not finite"))
        .when(F.col("points") < 2, F.concat(F.lit("not enough points: "), F.col("points").cast("string")))
        .when((target < lo - PSNR_EPS) | (target > hi + PSNR_EPS), F.lit("target outside the curve"))
    )
    rate = (
        F.when(F.abs(target - lo) <= PSNR_EPS, F.col("min_rate"))
        .when(F.abs(target - hi) <= PSNR_EPS, F.col("max_rate"))
        .otherwise(F.col("between"))
    )
    return (
        asked.join(hits, [by, "target"], "left")
        .withColumn("reason", reason)
        .select(by, "target", F.when(F.col("reason").isNull(), rate).alias("rate"), "reason")
    )


def nearest(points: DataFrame, targets: list[float], by: str = "curve") -> DataFrame:
    """The point closest to each target PSNR; ties go to the lower rate, then the lower ``idx``.

    The least distance and then the least rate are found first, so that only their ties are sorted.
    """
    key = [by, "target"]
    exploded = points.withColumn("target", F.explode(_target_array(targets)))
    keep = [*key, *[c for c in points.columns if c != by]]
    far = F.abs(F.col("psnr_db") - F.col("target"))
    order = F.struct(far, F.col("rate"), F.col("idx"))
    # Nulls come first in the order; numbers of fixed width are aggregated without a sort, wide rows are not.
    steps = {"__far": F.coalesce(far.cast("double"), F.lit(-1.0)), "__rate": F.coalesce(F.col("rate").cast("double"), F.lit(float("-inf")))}
    left = exploded.select(*keep)
    for name, value in steps.items():
        least = left.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min(value).alias(name))
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
        left = left.join(least, [*on, value.eqNullSafe(F.col(name))], "left_semi")
    return first_per_key(left, key, order)


def matched_targets(raw_psnr: float, quantized_psnr: float) -> list[float]:
    """The raw PSNR, and the quantised one when it differs by more than 1e-4."""
    return [raw_psnr] if abs(quantized_psnr - raw_psnr) <= 1e-4 else [raw_psnr, quantized_psnr]


def matched_quality(points: DataFrame, targets: list[float], by: str = "curve") -> DataFrame:
    """Per curve and target: interpolated rate, the metrics of the nearest point, or a note."""
    counted = points.groupBy(by).agg(F.count(F.lit(1)).alias("rd_points"))
    rated = rate_at(points, targets, by).join(counted, by)
    near = nearest(points, targets, by).select(by, "target", F.col("psnr_db").alias("nearest_psnr_db"), F.col("rate").alias("nearest_rate"))
    note = F.when(
        F.col("rd_points") < 2, F.concat(F.col(by), F.lit(": too few points to interpolate"))
    ).otherwise(F.concat(F.col(by), F.lit(": "), F.col("reason")))
    return (
        rated.join(near, [by, "target"], "left")
        .select(
            by, "target", "rate", "nearest_psnr_db", "nearest_rate",
            F.concat(
                F.lit("interp@psnr="), F.when(F.col("target") == float("inf"), "inf").otherwise(F.format_string("%.2f", "target"))
            ).alias("quality_control"),
            F.when(F.col("reason").isNotNull(), note).alias("note"),
        )
    )


def matched_to(ops: DataFrame, points: DataFrame, by: str = "curve") -> DataFrame:
    """``matched_quality`` at the combined PSNR of the raw and quantised operating points, with those two points beside."""
    own = {r["point"]: r for r in ops.where("modality = 'combined'").collect()}  # two rows
    raw, quantised = own["raw_f32"], own["quantized"]
    out = matched_quality(points, matched_targets(raw["psnr_db"], quantised["psnr_db"]), by)
    beside = {
        f"{name}_{c}": F.lit(float(row[c])) for name, row in (("raw", raw), ("quantized", quantised)) for c in ("rate_bpp", "psnr_db")
    }
    return out.withColumns(beside)


def summary_rows(ops: DataFrame, points: DataFrame, matched: DataFrame, by: str = "curve") -> DataFrame:
    """``method, mode, quality, rate_bpp, psnr_db, mse`` over operating points, curve points and matched points."""
    cols = ["method", "mode", "quality", "rate_bpp", "psnr_db", "mse"]
    own = ops.where("modality = 'combined'").select(
        F.concat(F.lit("latent-"), F.col("point")).alias("method"), F.lit("intra").alias("mode"), F.lit("-").alias("quality"),
        "rate_bpp", "psnr_db", "mse",
    )
    curve = points.select(
        F.col(by).alias("method"), F.col("mode"), F.col("quality"), F.col("rate").alias("rate_bpp"), "psnr_db", "mse"
    )
    interp = matched.where(F.col("note").isNull()).select(
        F.col(by).alias("method"), F.lit("matched").alias("mode"), F.col("quality_control").alias("quality"),
        F.col("rate").alias("rate_bpp"), F.col("nearest_psnr_db").alias("psnr_db"), F.lit(None).cast("double").alias("mse"),
    )
    return own.select(*cols).unionByName(curve.select(*cols)).unionByName(interp.select(*cols))
