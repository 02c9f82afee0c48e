"""Queries on file lists: pairing, companions, listings, selection, plans and stored tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewise.functions.arrays import digest
from framewise.plans import views
from framewise.plans.registry import Registry
from framewise.session import shared_dir, remember
from framewise.sinks import layout
from framewise.sources import filesets, tables

reg = Registry()

FILES = """f AS (SELECT doc_id AS seq, 'gs://bucket/' || path AS uri, path AS object_path, split, component, file_name, n_chars AS size_bytes
  FROM (SELECT *, split || '/' || component || '/' || file_name AS path FROM (SELECT doc_id, n_chars,
  CASE WHEN doc_id % 10 < 6 THEN 'training' WHEN doc_id % 10 = 6 THEN 'validation' WHEN doc_id % 10 = 7 THEN 'testing' ELSE 'other' END AS split,
  CASE WHEN doc_id % 3 = 0 THEN 'camera_image' ELSE 'lidar' END AS component,
  'doc_' || doc_id || '.parquet' AS file_name FROM documents)))"""


def files(spark, d):
    return views.file_list(views.table(spark, d, "documents"))


def _scratch(spark) -> str:
    return remember(f"{shared_dir(spark).rstrip('/')}/out-{uuid.uuid4().hex}")


@reg.add(
    "pair_component_files",
    """SELECT 'doc_' || doc_id AS file_name, 'camera_image/doc_' || doc_id AS camera_path, 'lidar/doc_' || doc_id AS lidar_path
    FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0""",
)
def pair_component_files(spark, d):
    return filesets.pair_files(*_sides(spark, d))


def _sides(spark, d):
    docs = views.table(spark, d, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return (
        docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("camera_image/"), name).alias("path")),
        docs.where("doc_id % 4 <> 0").select(F.concat(F.lit("lidar/"), name).alias("path")),
    )


@reg.add(
    "unpaired_component_files",
    """SELECT 'doc_' || doc_id AS file_name, 'camera_image/doc_' || doc_id AS path, 'camera' AS side FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0
    UNION ALL SELECT 'doc_' || doc_id, 'lidar/doc_' || doc_id, 'lidar' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0""",
)
def unpaired_component_files(spark, d):
    return filesets.unpaired_files(*_sides(spark, d))


@reg.add(
    "companion_files",
    f"""WITH {FILES}, u AS (SELECT uri, split, file_name, seq, size_bytes, 0 AS pass FROM f
      UNION ALL SELECT 'gs://bucket/' || split || '/camera_box/' || file_name, split, file_name, seq, NULL, 1 FROM f
      UNION ALL SELECT 'gs://bucket/' || split || '/lidar/' || file_name, split, file_name, seq, NULL, 2 FROM f)
    SELECT uri, size_bytes, 'raw/' || split || '/' || str_split(uri, '/')[5] || '/' || file_name AS target_path FROM u
    QUALIFY row_number() OVER (PARTITION BY uri ORDER BY pass, seq) = 1""",
)
def companion_files(spark, d):
    out = filesets.companions(files(spark, d), ["camera_box", "lidar"], "raw", "seq")
    return out.select("uri", "size_bytes", "target_path")


@reg.add(
    "box_path_rewrite",
    f"""WITH {FILES} SELECT seq, CASE WHEN component = 'camera_image'
      THEN split || '/camera_box/' || file_name ELSE split || '/lidar/' || file_name END AS box_path FROM f""",
)
def box_path_rewrite(spark, d):
    upper = F.when(F.col("seq") % 2 == 0, F.replace("object_path", F.lit("camera_image"), F.lit("Camera_Image"))).otherwise(F.col("object_path"))
    return files(spark, d).select("seq", filesets.box_path(upper).alias("box_path"))


LISTED = """SELECT doc_id AS line_no, 'gs://bucket/training/camera_image/doc_' || doc_id || '.parquet' AS uri, 'training' AS split,
  'doc_' || doc_id || '.parquet' AS file_name, CASE WHEN doc_id % 17 = 3 THEN NULL ELSE n_chars END AS size_bytes
  FROM documents WHERE doc_id % 17 = 3 OR doc_id % 17 > 5"""


@reg.add("listing_parse", LISTED)
def listing_parse(spark, d):
    return filesets.listing(views.listing_lines(views.table(spark, d, "documents")), "training", order="line_no")


@reg.add("listing_parse_limited", LISTED + " ORDER BY doc_id LIMIT 100")
def listing_parse_limited(spark, d):
    return filesets.listing(views.listing_lines(views.table(spark, d, "documents")), "training", limit=100, order="line_no")


APPENDED = f"""WITH {FILES}, k AS (SELECT uri, seq FROM f JOIN labels ON labels.doc_id = seq), n AS (SELECT regexp_replace(uri, '_[0-9]+', '_' || (seq - seq % 2)) AS uri, seq FROM f)
    SELECT uri, seq, false AS appended FROM k
    UNION ALL (SELECT uri, seq, true FROM n WHERE uri NOT IN (SELECT uri FROM k) QUALIFY row_number() OVER (PARTITION BY uri ORDER BY seq) = 1)"""


def _known_and_found(spark, d):
    """The files of all labelled documents are known; found are those of all documents, two names in one."""
    every = files(spark, d).select("uri", "seq")
    known = every.join(views.table(spark, d, "labels").select(F.col("doc_id").alias("seq")), "seq").select("uri", "seq")
    found = every.select(
        F.regexp_replace("uri", F.lit("_[0-9]+"), F.concat(F.lit("_"), (F.col("seq") - F.col("seq") % 2).cast("string"))).alias("uri"), "seq"
    )
    return known, found


@reg.add("append_unique_all_files", APPENDED)
def append_unique_all_files(spark, d):
    return filesets.append_unique(*_known_and_found(spark, d))


@reg.add("append_unique_buckets", f"SELECT uri, seq FROM ({APPENDED})")
def append_unique_buckets(spark, d):
    """The same list as a table in buckets of the name, to which new files are added and nothing is rewritten."""
    known, found = _known_and_found(spark, d)
    table = layout.BucketTable.create(known, _scratch(spark), "uri", buckets=16)
    table.append_unique(found, "seq")
    return table.rows().select("uri", "seq")


@reg.add(
    "top_files_per_split",
    f"""WITH {FILES} SELECT split, uri, split_rank FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY seq) AS split_rank FROM f)
    WHERE split_rank <= CASE split WHEN 'training' THEN 50 WHEN 'validation' THEN 7 ELSE 0 END""",
)
def top_files_per_split(spark, d):
    return filesets.top_per_split(files(spark, d), {"training": 50, "validation": 7}).select("split", "uri", "split_rank")


@reg.add(
    "split_shortfall",
    f"""WITH {FILES}, w AS (SELECT * FROM (VALUES ('training', 10::BIGINT), ('validation', 1000000::BIGINT), ('testing', 2000000::BIGINT)) v(split, wanted))
    SELECT split, wanted, least(wanted, n) AS selected FROM (SELECT w.split, w.wanted, count(f.seq) AS n FROM w LEFT JOIN f USING (split) GROUP BY w.split, w.wanted)
    WHERE n < wanted""",
)
def split_shortfall(spark, d):
    return filesets.shortfall(files(spark, d), {"training": 10, "validation": 1_000_000, "testing": 2_000_000})


@reg.add(
    "reconcile_sizes",
    f"""WITH {FILES}, e AS (SELECT object_path AS target_path, file_name, CASE WHEN seq % 9 = 0 THEN NULL ELSE size_bytes END AS size_bytes,
      CASE WHEN seq % 8 <> 0 THEN size_bytes + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END END AS length FROM f)
    SELECT target_path, CASE WHEN length IS NULL THEN 'failed' WHEN size_bytes IS NULL THEN 'downloaded'
      WHEN size_bytes = length THEN 'verified' ELSE 'failed' END AS status,
      CASE WHEN length IS NULL THEN 'file is not there: ' || file_name
      WHEN size_bytes <> length THEN file_name || ' has ' || length || ' bytes instead of ' || size_bytes END AS error
    FROM e""",
)
def reconcile_sizes(spark, d):
    every = files(spark, d).withColumn("target_path", F.col("object_path"))
    expected = every.select("target_path", "file_name", F.when(F.col("seq") % 9 != 0, F.col("size_bytes")).alias("size_bytes"))
    actual = every.where("seq % 8 <> 0").select(
        "target_path", (F.col("size_bytes") + (F.col("seq") % 7 == 0).cast("bigint")).alias("length")
    )
    return filesets.reconcile_sizes(expected, actual).select("target_path", "status", "error")


PLAN = f"""WITH {FILES}, g AS (SELECT uri AS object_uri, object_path, size_bytes,
  CASE split WHEN 'training' THEN 'train' WHEN 'validation' THEN 'val' WHEN 'testing' THEN 'test' END AS split FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY object_path, object_uri) AS rn FROM g WHERE split IS NOT NULL),
  p AS (SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, rn) - 1 AS plan_index,
    split, object_uri, object_path, size_bytes FROM r WHERE rn <= {{cap}})
  SELECT * FROM p WHERE plan_index < {{limit}}"""


def _raw(spark, d):
    return files(spark, d).select(F.col("uri").alias("object_uri"), "object_path", "size_bytes")


@reg.add("fetch_plan", PLAN.format(cap="1000000000", limit="1000000000"))
def fetch_plan(spark, d):
    return filesets.fetch_plan(_raw(spark, d))[0]


CAPS = "CASE split WHEN 'train' THEN 40 WHEN 'val' THEN 100000 ELSE 5 END"
TARGETS = {"train": 40, "val": 100_000, "test": 5}


@reg.add("fetch_plan_targets", PLAN.format(cap=CAPS, limit="60"))
def fetch_plan_targets(spark, d):
    return filesets.fetch_plan(_raw(spark, d), TARGETS, limit=60)[0]


@reg.add(
    "fetch_plan_warnings",
    f"""WITH {FILES} SELECT NULL::VARCHAR AS split, NULL::BIGINT AS requested, 0::BIGINT AS available,
      'no split in the path, left out: ' || object_path AS message FROM f WHERE split = 'other'
    UNION ALL SELECT 'val', 100000, count(*), 'val: 100000 files asked for, ' || count(*) || ' found'
    FROM f WHERE split = 'validation' HAVING count(*) < 100000""",
)
def fetch_plan_warnings(spark, d):
    return filesets.fetch_plan(_raw(spark, d), TARGETS, limit=60)[1]


@reg.add(
    "tensor_bytes_decode",
    """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda e: e::DOUBLE)), 6) + 0.0 AS total,
    round(list_sum(list_transform(embedding, lambda e, i: e::DOUBLE * i)), 5) + 0.0 AS weighted FROM embeddings""",
)
def tensor_bytes_decode(spark, d):
    """Vectors are packed to little-endian bytes by the view, then decoded by the scan."""

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda a: np.asarray(a, dtype="<f4").tobytes())

    raw = views.table(spark, d, "embeddings").select("vec_id", packed("embedding").alias("content"))
    decoded = raw.select("vec_id", tables.decode(F.col("content"), "f32").alias("values"))
    return decoded.select("vec_id", *digest(F.col("values")))


@reg.add("json_table_round_trip", "SELECT doc_id, quality, toxic, 2 AS schema_version FROM labels")
def json_table_round_trip(spark, d):
    path = _scratch(spark)
    tables.write_table(views.table(spark, d, "labels"), path, version=2)
    return tables.read_table(spark, path, "doc_id bigint, quality int, toxic int, schema_version int", version=2)


@reg.add(
    "epoch_metrics_scan",
    """SELECT l_linenumber AS epoch, round(avg(l_discount), 6) AS train_loss, count(*) AS samples FROM lineitem GROUP BY 1""",
)
def epoch_metrics_scan(spark, d):
    path = _scratch(spark)
    per_epoch = views.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(
        F.round(F.avg("l_discount"), 6).alias("train_loss"), F.count(F.lit(1)).alias("samples")
    )
    per_epoch.write.json(path)
    return tables.epoch_metrics(spark, path, "epoch int, train_loss double, samples bigint")


def _damaged_lines(events):
    """JSON lines of which some are cut short, or carry another version or none."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"event_id": '), i.cast("string"), F.lit(', "schema_version": '))
    text = (
        F.when(i % 50 == 0, F.concat(body, F.lit("1")))
        .when(i % 50 == 1, F.concat(body, F.lit("2}")))
        .when(i % 50 == 2, F.concat(F.lit('{"event_id": '), i.cast("string"), F.lit("}")))
        .otherwise(F.concat(body, F.lit("1}")))
    )
    return events.select(text.alias("value"), F.concat(F.lit("part-"), i.cast("string")).alias("file_name"))


@reg.add(
    "corrupt_record_report",
    """SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'version_mismatch' END AS kind, 'part-' || event_id AS location,
    CASE WHEN event_id % 50 = 0 THEN 'record is not valid JSON for this table'
    ELSE 'expected schema version 1, found ' || CASE WHEN event_id % 50 = 1 THEN '2' ELSE 'none' END END AS message
    FROM events WHERE event_id % 50 < 3""",
)
def corrupt_record_report(spark, d):
    raw = _damaged_lines(views.table(spark, d, "events"))
    parsed = raw.withColumn(
        "r",
        F.from_json(
            "value", "event_id bigint, schema_version int, _corrupt_record string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ),
    )
    return tables.corruption_diagnostics(parsed, 1).select("kind", "location", "message")


@reg.add(
    "corrupt_files_report",
    """SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'version_mismatch' END AS kind,
    CASE WHEN event_id % 50 = 0 THEN 'record is not valid JSON for this table'
    ELSE 'expected schema version 1, found ' || CASE WHEN event_id % 50 = 1 THEN '2' ELSE 'none' END END AS message, count(*) AS n, true AS named
    FROM events WHERE event_id % 50 < 3 GROUP BY ALL""",
)
def corrupt_files_report(spark, d):
    """Files with broken lines, blank lines and rows of other versions, read back as diagnostics."""
    path = _scratch(spark)
    lines = _damaged_lines(views.table(spark, d, "events")).select("value")
    lines.unionByName(lines.select(F.lit("  ").alias("value"))).write.text(path)
    found = tables.corrupt_rows(spark, path, "event_id bigint, schema_version int", 1)
    return found.groupBy("kind", "message").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("location").startswith("part-")).alias("named"))


@reg.add(
    "tensor_bytes_decode_small",
    """WITH k AS (SELECT vec_id, list_transform(embedding, lambda e: least(greatest(floor((e::DOUBLE + 1) / 2 * 255), 0), 255)) AS k FROM embeddings)
    SELECT vec_id, 'u8' AS dtype, len(k) AS n, round(list_sum(k), 6) + 0.0 AS total, round(list_sum(list_transform(k, lambda e, i: e * i)), 5) + 0.0 AS weighted FROM k
    UNION ALL SELECT vec_id, 'f16', len(k), round(list_sum(k) / 256, 6) + 0.0, round(list_sum(list_transform(k, lambda e, i: e * i / 256)), 5) + 0.0 FROM k""",
)
def tensor_bytes_decode_small(spark, d):
    """Vectors as bytes and as half-precision floats, decoded by the scan; both hold these values exactly."""

    def packed(dtype: str, divisor: int):
        @F.pandas_udf("binary")
        def pack(v: pd.Series) -> pd.Series:
            return v.map(lambda a: (np.clip(np.floor((np.asarray(a, np.float64) + 1) / 2 * 255), 0, 255) / divisor).astype(tables.DTYPES[dtype]).tobytes())

        return pack

    vectors = views.table(spark, d, "embeddings")
    parts = []
    for dtype, divisor in (("u8", 1), ("f16", 256)):
        raw = vectors.select("vec_id", packed(dtype, divisor)("embedding").alias("content"))
        decoded = raw.select("vec_id", F.lit(dtype).alias("dtype"), tables.decode(F.col("content"), dtype).alias("values"))
        parts.append(decoded.select("vec_id", "dtype", *digest(F.col("values"))))
    return parts[0].unionByName(parts[1])


@reg.add(
    "sample_table_write",
    """SELECT CASE vec_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
    sum(len(embedding))::BIGINT AS n_values, min(printf('sample_%06d', vec_id)) AS first_id FROM embeddings GROUP BY 1""",
)
def sample_table_write(spark, d):
    from framewise.sinks import writers

    path = _scratch(spark)
    writers.write_samples(views.tensors(views.table(spark, d, "embeddings")).select("sample_id", "split", "rgb", "range"), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("range")).cast("bigint").alias("n_values"), F.min("sample_id").alias("first_id")
    )
