"""Queries on array columns: normalisation, resampling, masks, packing and quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.functions import int8, tensors
from framewise.functions.arrays import digest
from framewise.operators import evaluate, ratedist
from framewise.plans import views
from framewise.plans.registry import Registry, r6

reg = Registry()

X = "x AS (SELECT vec_id, list_transform(embedding, lambda e: (e::DOUBLE + 1) / 2) AS x FROM embeddings)"
# interleaved 4 x 8 x 2 range image, short distances missing
RAW = """raw AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN abs(e::DOUBLE) * 150 < 7.5 THEN 0.0 ELSE abs(e::DOUBLE) * 150 END) AS v FROM embeddings)"""


def digest_sql(v: str) -> str:
    return f"""len({v}) AS n, round(list_sum(list_transform({v}, lambda e: e::DOUBLE)), 6) + 0.0 AS total,
    round(list_sum(list_transform({v}, lambda e, i: e::DOUBLE * i)), 5) + 0.0 AS weighted"""


def grid_sql(h: int, w: int, hs: int = 4, ws: int = 8) -> str:
    """Source taps of every output cell."""
    return f"""g AS (SELECT r * {w} + c AS k, y0, least(y0 + 1, {hs - 1}) AS y1, least(greatest(sy - y0, 0), 1) AS ty,
      x0, least(x0 + 1, {ws - 1}) AS x1, least(greatest(sx - x0, 0), 1) AS tx,
      least(greatest((sign(sy) * floor(abs(sy) + 0.5))::INT, 0), {hs - 1}) AS yn,
      least(greatest((sign(sx) * floor(abs(sx) + 0.5))::INT, 0), {ws - 1}) AS xn
      FROM (SELECT r, c, sy, sx, least(greatest(floor(sy)::INT, 0), {hs - 1}) AS y0, least(greatest(floor(sx)::INT, 0), {ws - 1}) AS x0
      FROM (SELECT r, c, (r + 0.5::DOUBLE) * ({hs}::DOUBLE / {h}) - 0.5 AS sy, (c + 0.5::DOUBLE) * ({ws}::DOUBLE / {w}) - 0.5 AS sx
      FROM range({h}) a(r), range({w}) b(c))))"""


def _at(y: str, x: str, ch: int, ws: int = 8) -> str:
    return f"v[({y} * {ws} + {x}) * 2 + {ch} + 1]"


def lerp_sql(ch: int) -> str:
    top = f"({_at('y0', 'x0', ch)} + tx * ({_at('y0', 'x1', ch)} - {_at('y0', 'x0', ch)}))"
    low = f"({_at('y1', 'x0', ch)} + tx * ({_at('y1', 'x1', ch)} - {_at('y1', 'x0', ch)}))"
    return f"({top} + ty * ({low} - {top}))"


def planes_sql(h: int, w: int) -> str:
    return f"""{RAW}, {grid_sql(h, w)}, pl AS (SELECT vec_id, list({lerp_sql(0)} ORDER BY k) AS rg, list({lerp_sql(1)} ORDER BY k) AS it,
      list(CASE WHEN {_at('yn', 'xn', 0)} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY k) AS va FROM raw, g GROUP BY vec_id)"""


CLAMPED = "list_transform(rg, lambda e: least(greatest(e / 75, 0), 1))"
NORMED = "list_transform(it, lambda e: CASE WHEN list_max(it) > 0 THEN least(greatest(e / list_max(it), 0), 1) ELSE e END)"


def emb(spark, d):
    return views.array_table(spark, d, "embeddings", "vec_id")


def raw(spark, d):
    return views.raw_range(emb(spark, d))


DIMS = ("h", "w", "c")


def dims():
    return [F.col(c) for c in DIMS]


@reg.add(
    "rgb_planar",
    f"""WITH p AS (SELECT vec_id, list_transform(embedding[1:48], lambda e: floor((e::DOUBLE + 1) / 2 * 255)) AS b FROM embeddings),
    q AS (SELECT vec_id, flatten([list_transform(range(16), lambda i: b[3 * i + 1] / 255), list_transform(range(16), lambda i: b[3 * i + 2] / 255),
      list_transform(range(16), lambda i: b[3 * i + 3] / 255)]) AS v FROM p)
    SELECT vec_id, {digest_sql('v')} FROM q""",
)
def rgb_planar(spark, d):
    pixels = F.transform(F.slice("embedding", 1, 48), lambda e: F.floor((e.cast("double") + 1) / 2 * 255).cast("int"))
    return emb(spark, d).select("vec_id", tensors.rgb_chw(pixels).alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add("range_bilinear_up", f"WITH {planes_sql(8, 16)} SELECT vec_id, {digest_sql('rg')} FROM pl")
def range_bilinear_up(spark, d):
    v = tensors.bilinear(F.col("values"), *dims(), 8, 16, 0)
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add("range_bilinear_down", f"WITH {planes_sql(2, 4)} SELECT vec_id, {digest_sql('it')} FROM pl")
def range_bilinear_down(spark, d):
    v = tensors.bilinear(F.col("values"), *dims(), 2, 4, 1)
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add("range_clamp_scale", f"WITH {planes_sql(2, 4)} SELECT vec_id, {digest_sql(CLAMPED)} FROM pl")
def range_clamp_scale(spark, d):
    v = tensors.clamp_scale(tensors.bilinear(F.col("values"), *dims(), 2, 4, 0))
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add("intensity_max_norm", f"WITH {planes_sql(2, 4)} SELECT vec_id, {digest_sql(NORMED)} FROM pl")
def intensity_max_norm(spark, d):
    v = tensors.max_norm(tensors.bilinear(F.col("values"), *dims(), 2, 4, 1))
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add("validity_mask", f"WITH {planes_sql(8, 16)} SELECT vec_id, {digest_sql('va')} FROM pl")
def validity_mask(spark, d):
    v = tensors.validity(F.col("values"), *dims(), 8, 16)
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


@reg.add(
    "validity_stats",
    f"""WITH {planes_sql(2, 4)} SELECT vec_id, list_sum(va)::BIGINT AS valid_pixels, 8::BIGINT AS total_pixels,
    list_sum(va) / 8 AS valid_fraction FROM pl""",
)
def validity_stats(spark, d):
    stats = tensors.validity_stats(tensors.validity(F.col("values"), *dims(), 2, 4))
    return raw(spark, d).select("vec_id", stats.alias("s")).select("vec_id", "s.*")


@reg.add("range_stack", f"WITH {planes_sql(2, 4)}, s AS (SELECT vec_id, flatten([va, {CLAMPED}, {NORMED}]) AS v FROM pl) SELECT vec_id, {digest_sql('v')} FROM s")
def range_stack(spark, d):
    v = tensors.range_chw(F.col("values"), *dims(), 2, 4, ["Mask", "distance", "intensity"])
    return raw(spark, d).select("vec_id", v.alias("v")).select("vec_id", *digest(F.col("v")))


def _pack_sql(rounding: str) -> str:
    scaled = "least(greatest(x[c * 16 + i + 1] * 1.2 - 0.1, 0), 1) * 255"
    q = f"floor({scaled} + 0.5)" if rounding == "round" else f"floor({scaled})"
    return f"""WITH {X}, p AS (SELECT vec_id, list({q}::INT ORDER BY i, c) AS v FROM x, range(16) a(i), range(3) b(c) GROUP BY vec_id)
    SELECT vec_id, {digest_sql('v')} FROM p"""


def stretched(spark, d):
    """RGB tensors that leave [0, 1] a little, so clamping shows."""
    tens = views.tensors(emb(spark, d))
    return tens.select("vec_id", F.transform("rgb", lambda v: v * 1.2 - 0.1).alias("rgb"), F.transform("range", lambda v: v * 1.2 - 0.1).alias("range"))


@reg.add("pack_rgb_round", _pack_sql("round"))
def pack_rgb_round(spark, d):
    return stretched(spark, d).select("vec_id", *digest(tensors.pack_rgb_u8(F.col("rgb"))))


@reg.add("pack_rgb_truncate", _pack_sql("truncate"))
def pack_rgb_truncate(spark, d):
    return stretched(spark, d).select("vec_id", *digest(tensors.pack_rgb_u8(F.col("rgb"), "truncate")))


U8 = "floor(least(greatest(x[{i}] * 1.2 - 0.1, 0), 1) * 255 + 0.5)"


@reg.add(
    "pack_range_round",
    f"""WITH {X}, p AS (SELECT vec_id, flatten(list([{U8.format(i='i + 1')}, {U8.format(i='i + 33')}, 0] ORDER BY i)) AS v FROM x, range(32) a(i) GROUP BY vec_id)
    SELECT vec_id, {digest_sql('v')} FROM p""",
)
def pack_range_round(spark, d):
    return stretched(spark, d).select("vec_id", *digest(tensors.pack_range_u8(F.col("range"), 32)))


@reg.add(
    "unpack_range",
    f"""WITH {X}, p AS (SELECT vec_id, list({U8.format(i='i + 1')} / 255 ORDER BY i) AS v FROM x, range(64) a(i) GROUP BY vec_id)
    SELECT vec_id, {digest_sql('v')} FROM p""",
)
def unpack_range(spark, d):
    return stretched(spark, d).select("vec_id", *digest(tensors.unpack_u8(tensors.pack_range_u8(F.col("range"), 32), 2)))


@reg.add(
    "unpack_rgb",
    f"""WITH {X}, p AS (SELECT vec_id, list({U8.format(i='i + 1')} / 255 ORDER BY i) AS v FROM x, range(48) a(i) GROUP BY vec_id)
    SELECT vec_id, {digest_sql('v')} FROM p""",
)
def unpack_rgb(spark, d):
    return stretched(spark, d).select("vec_id", *digest(tensors.unpack_u8(tensors.pack_rgb_u8(F.col("rgb")), 3)))


@reg.add(
    "abs_error_map",
    f"""WITH {X}, p AS (SELECT vec_id, list_transform(x, lambda e, i: CASE WHEN vec_id % 7 = 0 THEN 0 ELSE abs(sin(i - 1) * 0.05) * 4 END) AS v FROM x WHERE vec_id % 13 <> 0)
    SELECT vec_id, {digest_sql('v')} FROM p""",
)
def abs_error_map(spark, d):
    tens = views.tensors(emb(spark, d)).where(F.col("range_hat").isNotNull())
    return tens.select("vec_id", *digest(tensors.abs_error(F.col("range_hat"), F.col("range"))))


def _stats_sql(name: str, lo: int, hi: int) -> str:
    return f"""SELECT '{name}' AS tensor, round(min(e), 6) AS min, round(max(e), 6) AS max, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std
    FROM (SELECT unnest(x[{lo}:{hi}]) AS e FROM x)"""


@reg.add(
    "tensor_stats",
    f"""WITH {X}, s AS ({_stats_sql('rgb', 1, 48)} UNION ALL {_stats_sql('range_0', 1, 32)} UNION ALL {_stats_sql('range_1', 33, 64)})
    SELECT *, (SELECT round(avg((e > 0)::INT), 6) FROM (SELECT unnest(x[1:32]) AS e FROM x)) AS valid_fraction FROM s""",
)
def tensor_stats(spark, d):
    out = evaluate.stats(views.tensors(emb(spark, d)), "rgb", "range", 32)
    return out.select("tensor", *[r6(c) for c in ("min", "max", "mean", "std", "valid_fraction")])


QUANT = """v AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN vec_id % 50 = 0 THEN 0.25::FLOAT ELSE e END) AS v FROM embeddings),
  b AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi, greatest(abs(list_min(v)), abs(list_max(v))) AS m FROM v),
  asym AS (SELECT *, CASE WHEN lo = hi THEN 1::FLOAT ELSE ((hi - lo) / 255::FLOAT)::FLOAT END AS scale, lo AS lo2, hi AS hi2 FROM b),
  sym AS (SELECT *, CASE WHEN lo = hi THEN 1::FLOAT ELSE (m / 127::FLOAT)::FLOAT END AS scale, CASE WHEN lo = hi THEN lo ELSE -m END AS lo2, CASE WHEN lo = hi THEN hi ELSE m END AS hi2 FROM b),
  asymz AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE least(greatest(sign(z) * floor(abs(z) + 0.5), -128), 127) END::INT AS zp
    FROM (SELECT *, ((-128)::FLOAT - (lo / scale)::FLOAT)::DOUBLE AS z FROM asym)),
  symz AS (SELECT *, 0 AS zp FROM sym),
"""


def _codes_sql(src: str) -> str:
    q = "((least(greatest(e, lo2), hi2) / scale)::FLOAT + zp::FLOAT)::DOUBLE"
    return f"""c AS (SELECT *, list_transform(v, lambda e: CASE WHEN lo = hi THEN 0 ELSE least(greatest(sign({q}) * floor(abs({q}) + 0.5), -128), 127) END::INT) AS codes FROM {src}),
    r AS (SELECT *, list_transform(codes, lambda q: CASE WHEN lo = hi THEN lo2 ELSE least(greatest((q - zp)::FLOAT * scale, lo2), hi2) END) AS restored FROM c)"""


def vectors(spark, d):
    """Embeddings where every fiftieth vector is constant."""
    return emb(spark, d).select(
        "vec_id", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda _: F.lit(0.25).cast("float"))).otherwise(F.col("embedding")).alias("embedding")
    )


META_SQL = "vec_id, round(scale::DOUBLE, 9) AS scale, zp AS zero_point, round(lo2::DOUBLE, 6) AS min_value, round(hi2::DOUBLE, 6) AS max_value"


def _meta(spark, d, policy):
    return vectors(spark, d).select("vec_id", int8.int8_meta(F.col("embedding"), policy).alias("m")).select(
        "vec_id", F.round(F.col("m.scale").cast("double"), 9).alias("scale"), F.col("m.zero_point").cast("int").alias("zero_point"),
        r6("m.min_value", "min_value"), r6("m.max_value", "max_value"),
    )


@reg.add("int8_meta_asymmetric", f"WITH {QUANT} {_codes_sql('asymz')} SELECT {META_SQL} FROM asymz")
def int8_meta_asymmetric(spark, d):
    return _meta(spark, d, "asymmetric")


@reg.add("int8_meta_symmetric", f"WITH {QUANT} {_codes_sql('symz')} SELECT {META_SQL} FROM symz")
def int8_meta_symmetric(spark, d):
    return _meta(spark, d, "symmetric")


@reg.add("int8_codes_asymmetric", f"WITH {QUANT} {_codes_sql('asymz')} SELECT vec_id, {digest_sql('codes')} FROM c")
def int8_codes_asymmetric(spark, d):
    return ratedist.quantized(vectors(spark, d)).select("vec_id", *digest(F.col("codes")))


@reg.add("int8_codes_symmetric", f"WITH {QUANT} {_codes_sql('symz')} SELECT vec_id, {digest_sql('codes')} FROM c")
def int8_codes_symmetric(spark, d):
    return ratedist.quantized(vectors(spark, d), policy="symmetric").select("vec_id", *digest(F.col("codes")))


@reg.add("int8_restored", f"WITH {QUANT} {_codes_sql('asymz')} SELECT vec_id, {digest_sql('restored')} FROM r")
def int8_restored(spark, d):
    return ratedist.quantized(vectors(spark, d)).select("vec_id", *digest(F.col("restored")))


@reg.add("payload_sizes", "SELECT vec_id, (4 * len(embedding))::BIGINT AS raw_bytes, (22 + len(embedding))::BIGINT AS payload_bytes FROM embeddings")
def payload_sizes(spark, d):
    return ratedist.payload_sizes(vectors(spark, d), keep=("vec_id",))


@reg.add(
    "bits_per_pixel",
    """SELECT label, sum(4 * len(embedding))::BIGINT AS bytes, round(sum(4 * len(embedding)) * 8.0::DOUBLE / (count(*) * 48), 6) AS rate_bpp FROM embeddings GROUP BY label""",
)
def bits_per_pixel(spark, d):
    out = emb(spark, d).groupBy("label").agg(
        F.sum(ratedist.raw_bytes(F.col("embedding"))).alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    return out.select("label", "bytes", r6(ratedist.bpp(F.col("bytes"), F.col("n"), 48), "rate_bpp"))
