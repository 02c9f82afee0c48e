"""Queries on sensor frames: scans, alignment, labels and the prepare flow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import align, labels, splits
from framewise.plans import views
from framewise.plans.prepare import align_report
from framewise.plans.registry import Registry
from framewise.session import remember, shared_dir
from framewise.sinks import layout
from framewise.sources import scan

reg = Registry()

DAY = 86_400_000_000
KEYS_SQL = """printf('part-%02d.parquet', user_id % 16) AS file_name, event_id AS seq, user_id::VARCHAR AS segment"""
DAY_TS = "(epoch_us(date_trunc('day', ts))) AS timestamp_micros"
MICRO_TS = "epoch_us(ts) AS timestamp_micros"
CAM = f"cam AS (SELECT {KEYS_SQL}, {DAY_TS}, props FROM events WHERE event_type = 'view')"
LID = f"lid AS (SELECT {KEYS_SQL}, {DAY_TS}, value, event_id FROM events WHERE event_type = 'click')"
BOX = f"""box AS (SELECT {KEYS_SQL}, {DAY_TS},
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 9 END AS type
  FROM events WHERE event_id % 10 <> 0)"""
COUNTS = """counts AS (SELECT segment, timestamp_micros,
  count(*) FILTER (type = 1) AS vehicle_count, count(*) FILTER (type = 2) AS pedestrian_count,
  count(*) FILTER (type = 3) AS sign_count, count(*) FILTER (type = 4) AS cyclist_count
  FROM box WHERE type BETWEEN 1 AND 4 GROUP BY ALL)"""
PAIRS = """pairs AS (SELECT c.file_name, c.segment, c.timestamp_micros, c.seq AS camera_seq, l.seq AS lidar_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY file_name, segment, timestamp_micros ORDER BY seq) k FROM cam) c
  JOIN (SELECT *, row_number() OVER (PARTITION BY file_name, segment, timestamp_micros ORDER BY seq DESC) k FROM lid) l
  USING (file_name, segment, timestamp_micros, k))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events")


def camera(spark: SparkSession, d: str, exact: bool = True) -> DataFrame:
    return scan.camera_frames(views.raw_camera(events(spark, d), exact))


def lidar(spark: SparkSession, d: str, exact: bool = True) -> DataFrame:
    return scan.lidar_frames(views.raw_lidar(events(spark, d), exact))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return scan.box_rows(views.raw_boxes(events(spark, d)))


@reg.add(
    "camera_scan",
    f"WITH {CAM} SELECT file_name, seq, segment, timestamp_micros, octet_length(encode(props)) AS image_bytes FROM cam",
)
def camera_scan(spark, d):
    return camera(spark, d).select(
        "file_name", "seq", "segment", "timestamp_micros", F.octet_length("image").alias("image_bytes")
    )


@reg.add(
    "camera_scan_capped",
    f"""WITH {CAM} SELECT file_name, seq, segment, timestamp_micros FROM cam
    QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY seq) <= 25""",
)
def camera_scan_capped(spark, d):
    frames = scan.camera_frames(views.raw_camera(events(spark, d)), sensor=1, max_per_file=25)
    return frames.select("file_name", "seq", "segment", "timestamp_micros")


@reg.add(
    "lidar_scan",
    f"""WITH {LID} SELECT file_name, seq, segment, timestamp_micros,
    CASE WHEN event_id % 7 <> 0 THEN 4 ELSE 0 END AS n_values,
    CASE WHEN event_id % 7 <> 0 THEN round(value::FLOAT::DOUBLE, 4) END AS first_value,
    CASE WHEN event_id % 7 <> 0 THEN 4 ELSE 0 END AS shape_cells FROM lid""",
)
def lidar_scan(spark, d):
    return lidar(spark, d).select(
        "file_name", "seq", "segment", "timestamp_micros", F.size("range_values").alias("n_values"),
        F.round(F.get("range_values", F.lit(0)).cast("double"), 4).alias("first_value"),
        F.aggregate("shape", F.lit(1), lambda a, s: a * s).alias("shape_cells"),
    )


@reg.add(
    "sensor_id_normalize",
    """SELECT CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS sensor, count(*) AS frames
    FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL""",
)
def sensor_id_normalize(spark, d):
    raw = views.raw_lidar(events(spark, d))
    ids = raw.select(scan.sensor_id(raw, scan.find_column(raw, scan.LASER_NAME)).alias("sensor"))
    return ids.groupBy("sensor").agg(F.count(F.lit(1)).alias("frames"))


@reg.add(
    "align_exact",
    f"WITH {CAM}, {LID}, {PAIRS} SELECT file_name, segment, timestamp_micros, camera_seq, lidar_seq FROM pairs",
)
def align_exact(spark, d):
    pairs = align.exact(camera(spark, d), lidar(spark, d))
    return pairs.select("file_name", "segment", "timestamp_micros", "camera_seq", "lidar_seq")


NEAREST = f"""WITH RECURSIVE
cam AS (SELECT {KEYS_SQL}, {MICRO_TS} FROM events WHERE event_type = 'view'),
lid AS (SELECT {KEYS_SQL}, {MICRO_TS} FROM events WHERE event_type = 'click'),
cams AS (SELECT file_name, segment, list(struct_pack(t := timestamp_micros, s := seq) ORDER BY seq) AS c FROM cam GROUP BY ALL),
lids AS (SELECT file_name, segment, list(struct_pack(t := timestamp_micros, s := seq) ORDER BY seq) AS l FROM lid GROUP BY ALL),
step AS (
  SELECT file_name, segment, c, l AS free, 0 AS i, NULL::STRUCT(d BIGINT, t BIGINT, s BIGINT) AS best FROM cams JOIN lids USING (file_name, segment)
  UNION ALL
  SELECT file_name, segment, c,
    CASE WHEN pick.d <= {DAY} THEN list_filter(free, lambda f: f.s <> -pick.s) ELSE free END, i + 1, pick
  FROM (SELECT *, list_min(list_transform(free, lambda f: struct_pack(d := abs(f.t - c[i + 1].t), t := f.t, s := -f.s))) AS pick
        FROM step WHERE i < len(c))
)
"""


@reg.add(
    "align_nearest",
    NEAREST
    + f"""SELECT file_name, segment, c[i].t AS timestamp_micros, c[i].s AS camera_seq, -best.s AS lidar_seq,
    best.t AS lidar_timestamp_micros, best.d AS abs_delta_micros FROM step WHERE i > 0 AND best.d <= {DAY}""",
)
def align_nearest(spark, d):
    return align.nearest(camera(spark, d, False), lidar(spark, d, False), DAY)


@reg.add(
    "align_stats",
    f"""WITH {CAM}, {LID}, {PAIRS},
    u AS (SELECT file_name, 1 AS c, 0 AS l, 0 AS m FROM cam UNION ALL SELECT file_name, 0, 1, 0 FROM lid
          UNION ALL SELECT file_name, 0, 0, 1 FROM pairs)
    SELECT file_name, sum(c)::BIGINT AS camera_frames, sum(l)::BIGINT AS lidar_frames, sum(m)::BIGINT AS matched_pairs,
    sum(c - m)::BIGINT AS unmatched_camera, sum(l - m)::BIGINT AS unmatched_lidar, 0::BIGINT AS max_abs_delta_micros
    FROM u GROUP BY file_name""",
)
def align_stats(spark, d):
    cam, lid = camera(spark, d), lidar(spark, d)
    return align.stats(cam, lid, align.exact(cam, lid))


@reg.add(
    "align_nearest_stats",
    NEAREST
    + f""", m AS (SELECT file_name, count(*) AS n, max(best.d) AS d FROM step WHERE i > 0 AND best.d <= {DAY} GROUP BY 1)
    SELECT f.file_name, f.c AS camera_frames, f.l AS lidar_frames, coalesce(n, 0) AS matched_pairs,
    f.c - coalesce(n, 0) AS unmatched_camera, f.l - coalesce(n, 0) AS unmatched_lidar, coalesce(d, 0) AS max_abs_delta_micros
    FROM (SELECT file_name, sum(c)::BIGINT AS c, sum(l)::BIGINT AS l FROM (SELECT file_name, 1 AS c, 0 AS l FROM cam UNION ALL
    SELECT file_name, 0, 1 FROM lid) GROUP BY 1) f LEFT JOIN m USING (file_name)""",
)
def align_nearest_stats(spark, d):
    cam, lid = camera(spark, d, False), lidar(spark, d, False)
    return align.stats(cam, lid, align.nearest(cam, lid, DAY))


@reg.add(
    "unmatched_frames",
    f"""WITH {CAM}, {LID} SELECT segment, timestamp_micros, seq FROM cam
    WHERE (segment, timestamp_micros) NOT IN (SELECT (segment, timestamp_micros) FROM lid)""",
)
def unmatched_frames(spark, d):
    out = align.unmatched(camera(spark, d), lidar(spark, d), ["segment", "timestamp_micros"])
    return out.select("segment", "timestamp_micros", "seq")


@reg.add(
    "matched_frames",
    f"""WITH {CAM}, {LID} SELECT segment, timestamp_micros, seq FROM cam
    WHERE (segment, timestamp_micros) IN (SELECT (segment, timestamp_micros) FROM lid)""",
)
def matched_frames(spark, d):
    out = align.matched(camera(spark, d), lidar(spark, d), ["segment", "timestamp_micros"])
    return out.select("segment", "timestamp_micros", "seq")


@reg.add("box_counts", f"WITH {BOX}, {COUNTS} SELECT * FROM counts")
def box_counts(spark, d):
    return labels.box_counts(boxes(spark, d))


PRESENT = ", ".join(f"({c}_count > 0)::TINYINT AS {c}_present" for c in labels.CLASSES)


@reg.add("class_presence", f"WITH {BOX}, {COUNTS} SELECT *, {PRESENT} FROM counts")
def class_presence(spark, d):
    return labels.presence(labels.box_counts(boxes(spark, d)))


FILLED = ", ".join(f"coalesce({c}_count, 0) AS {c}_count" for c in labels.CLASSES)


@reg.add(
    "label_attach",
    f"""WITH {CAM}, {LID}, {PAIRS}, {BOX}, {COUNTS},
    j AS (SELECT p.file_name, p.segment, p.timestamp_micros, camera_seq, {FILLED}
          FROM pairs p LEFT JOIN counts USING (segment, timestamp_micros))
    SELECT *, {PRESENT} FROM j""",
)
def label_attach(spark, d):
    pairs = align.exact(camera(spark, d), lidar(spark, d)).select("file_name", "segment", "timestamp_micros", "camera_seq")
    return labels.attach(pairs, labels.box_counts(boxes(spark, d)))


BACKFILL = f"""WITH {CAM}, {LID}, {PAIRS}, {BOX},
    last AS (SELECT segment, timestamp_micros,
       count(*) FILTER (type = 1) AS vehicle_count, count(*) FILTER (type = 2) AS pedestrian_count,
       count(*) FILTER (type = 3) AS sign_count, count(*) FILTER (type = 4) AS cyclist_count
       FROM (SELECT *, printf('part-%02d', seq % 3) AS src FROM box WHERE type BETWEEN 1 AND 4)
       GROUP BY src, segment, timestamp_micros
       QUALIFY row_number() OVER (PARTITION BY segment, timestamp_micros ORDER BY src DESC) = 1),
    v AS (SELECT DISTINCT segment, timestamp_micros, 1::BIGINT AS valid_pixels FROM pairs WHERE lidar_seq % 7 <> 0)
    SELECT *, {PRESENT} FROM (SELECT c.seq, c.segment, c.timestamp_micros, {FILLED},
       coalesce(valid_pixels, 0) AS valid_pixels, 2::BIGINT AS total_pixels,
       (CASE WHEN valid_pixels = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS valid_fraction
       FROM cam c LEFT JOIN last USING (segment, timestamp_micros) LEFT JOIN v USING (segment, timestamp_micros))"""


@reg.add("label_backfill", BACKFILL)
def label_backfill(spark, d):
    """Boxes are spread over three source files; the last file that knows a frame wins."""
    samples, raw, valid = _backfill_sources(spark, d)
    return labels.backfill(samples, raw, valid, total_pixels=2)


def _backfill_sources(spark, d):
    cam, lid = camera(spark, d), lidar(spark, d)
    raw = views.raw_boxes(events(spark, d)).withColumn("file_name", F.format_string("part-%02d", F.col("seq") % 3))
    pairs = align.exact(cam, lid).where("lidar_seq % 7 <> 0").select(
        "file_name", "segment", "timestamp_micros", F.array(F.lit(1.0), F.lit(0.0)).alias("mask")
    )
    return cam.select("seq", "segment", "timestamp_micros"), scan.box_rows(raw), labels.frame_validity(pairs)


@reg.add("label_backfill_bucketed", BACKFILL)
def label_backfill_bucketed(spark, d):
    """The same labels from a sister table: samples are bucketed once, a backfill rewrites labels only."""
    samples, raw, valid = _backfill_sources(spark, d)
    names = {n: f"framewise_{n}_{uuid.uuid4().hex}" for n in ("samples", "labels")}
    paths = {n: remember(f"{shared_dir(spark).rstrip('/')}/{t}") for n, t in names.items()}
    layout.write_bucketed(samples, names["samples"], paths["samples"], labels.FRAME, 8)
    layout.write_bucketed(labels.label_table(spark.table(names["samples"]), raw, valid, 2), names["labels"], paths["labels"], labels.FRAME, 8)
    return layout.labelled(spark, names["samples"], names["labels"], labels.FRAME)


@reg.add(
    "sequential_ids",
    f"""WITH {CAM} SELECT file_name, seq,
    printf('sample_%06d', row_number() OVER (ORDER BY file_name, seq) - 1) AS sample_id FROM cam""",
)
def sequential_ids(spark, d):
    frames = camera(spark, d).select("file_name", "seq")
    return splits.sequential_id(frames, [F.col("file_name"), F.col("seq")])


@reg.add(
    "align_label_report",
    f"""WITH {CAM}, {LID}, {PAIRS}, {BOX}, {COUNTS},
    f AS (SELECT segment, count(*) AS camera_frames FROM cam GROUP BY 1),
    g AS (SELECT segment, count(*) AS lidar_frames FROM lid GROUP BY 1),
    m AS (SELECT segment, count(*) AS matched_pairs, sum(coalesce(vehicle_count, 0))::BIGINT AS vehicles,
      sum(coalesce(pedestrian_count, 0))::BIGINT AS pedestrians, count(*) FILTER (coalesce(sign_count, 0) > 0) AS frames_with_sign
      FROM pairs LEFT JOIN counts USING (segment, timestamp_micros) GROUP BY 1)
    SELECT segment, coalesce(camera_frames, 0) AS camera_frames, coalesce(lidar_frames, 0) AS lidar_frames,
      coalesce(matched_pairs, 0) AS matched_pairs, coalesce(vehicles, 0) AS vehicles, coalesce(pedestrians, 0) AS pedestrians,
      coalesce(frames_with_sign, 0) AS frames_with_sign
    FROM f FULL JOIN g USING (segment) LEFT JOIN m USING (segment)""",
)
def align_label_report(spark, d):
    return align_report(camera(spark, d), lidar(spark, d), boxes(spark, d))


SAMPLES = f"""s AS (SELECT p.*, printf('sample_%06d', row_number() OVER (ORDER BY file_name, camera_seq) - 1) AS sample_id FROM pairs p)"""


@reg.add(
    "extraction_rows",
    f"""WITH {CAM}, {LID}, {PAIRS}, {SAMPLES}
    SELECT file_name, min(sample_id) AS first_sample_id, max(sample_id) AS last_sample_id FROM s GROUP BY 1""",
)
def extraction_rows(spark, d):
    pairs = align.exact(camera(spark, d), lidar(spark, d))
    return align.sample_bounds(splits.sequential_id(pairs, [F.col("file_name"), F.col("camera_seq")]))


@reg.add(
    "prepare_samples",
    f"""WITH {CAM}, {LID}, {PAIRS}, {BOX}, {COUNTS}, {SAMPLES},
    j AS (SELECT printf('sample_%06d', row_number() OVER (ORDER BY s.file_name, s.camera_seq) - 1) AS sample_id, s.file_name, s.segment, s.timestamp_micros,
      octet_length(encode(c.props)) AS image_bytes, {FILLED},
      round(least(greatest(l.value::FLOAT::DOUBLE / 75, 0), 1), 6) AS first_depth, 2::BIGINT AS total_pixels,
      (l.value::FLOAT > 0)::BIGINT AS valid_pixels
      FROM s JOIN cam c ON c.seq = s.camera_seq JOIN lid l ON l.seq = s.lidar_seq
      LEFT JOIN counts q ON q.segment = s.segment AND q.timestamp_micros = s.timestamp_micros
      WHERE s.lidar_seq % 7 <> 0)
    SELECT * FROM j""",
)
def prepare_samples(spark, d):
    """The whole flow; frames whose range image is missing have no pixels and are left out before ids are given."""
    from framewise.plans.prepare import prepare

    out = prepare(camera(spark, d), lidar(spark, d), boxes(spark, d), h=1, w=2, skip_empty_range=True)
    return out.select(
        "sample_id", "file_name", "segment", "timestamp_micros", F.octet_length("image").cast("bigint").alias("image_bytes"),
        *[f"{c}_count" for c in labels.CLASSES], F.round(F.get("range", F.lit(0)), 6).alias("first_depth"),
        "total_pixels", "valid_pixels",
    )
