"""Queries that check tables against integrity rules. Damage is injected by row number over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import rules
from framewise.plans import views
from framewise.plans.files import FILES, files
from framewise.plans.registry import Registry

reg = Registry()


def hinted(sql: str) -> str:
    """The SQL of a table check with the hint of each kind."""
    cases = " ".join(f"WHEN '{k}' THEN '{h}'" for k, h in rules.HINTS.items())
    return f"SELECT *, CASE kind {cases} END AS hint FROM ({sql})"


def _dup_sql(src: str, field: str, kind: str, table: str, order: str = "idx", value: str | None = None) -> str:
    v = value or field
    return f"""SELECT '{kind}' AS kind, '{table}[' || idx || '].{field}' AS location, '{field} again: ' || {v} AS message
      FROM (SELECT *, row_number() OVER (PARTITION BY {v} ORDER BY {order}) AS nth FROM {src} WHERE trim({v}) <> '') WHERE nth = 2"""


RAW = f"""{FILES}, r AS (SELECT seq AS idx, CASE WHEN seq % 41 = 0 THEN '  ' WHEN seq % 20 = 7 THEN 'gs://bucket/shared-' || seq % 3 ELSE uri END AS object_uri,
  CASE WHEN seq % 37 = 0 THEN '' WHEN seq % 29 = 3 THEN 'copy/' || seq % 5 ELSE object_path END AS object_path,
  CASE WHEN seq % 31 = 0 THEN 0 ELSE size_bytes END AS size_bytes,
  CASE WHEN seq % 23 = 0 THEN seq + 1 ELSE seq END AS plan_index FROM f)"""


def raw_files(spark, d):
    i = F.col("seq")
    return files(spark, d).select(
        i.alias("idx"),
        F.when(i % 41 == 0, "  ").when(i % 20 == 7, F.concat(F.lit("gs://bucket/shared-"), (i % 3).cast("string"))).otherwise(F.col("uri")).alias("object_uri"),
        F.when(i % 37 == 0, "").when(i % 29 == 3, F.concat(F.lit("copy/"), (i % 5).cast("string"))).otherwise(F.col("object_path")).alias("object_path"),
        F.when(i % 31 == 0, 0).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(i % 23 == 0, i + 1).otherwise(i).alias("plan_index"),
    )


def _local_sql(kind: str, table: str = "files", src: str = "r") -> str:
    return " UNION ALL ".join(
        [
            f"SELECT '{kind}' AS kind, '{table}[' || idx || '].{c}' AS location, '{c} is blank' AS message FROM {src} WHERE trim({c}) = ''"
            for c in ("object_uri", "object_path")
        ]
        + [f"SELECT '{kind}', '{table}[' || idx || '].size_bytes', 'size_bytes is not a positive number' FROM {src} WHERE size_bytes <= 0"]
    )


@reg.add(
    "raw_file_rules",
    hinted(
    f"WITH {RAW} {_local_sql('raw_files')} UNION ALL {_dup_sql('r', 'object_uri', 'raw_files', 'files')} UNION ALL {_dup_sql('r', 'object_path', 'raw_files', 'files')}"
    ),
)
def raw_file_rules(spark, d):
    return rules.raw_file_rules(raw_files(spark, d))


@reg.add(
    "download_plan_rules",
    hinted(
    f"""WITH {RAW} {_local_sql('download_plan')} UNION ALL {_dup_sql('r', 'object_uri', 'download_plan', 'files')}
    UNION ALL {_dup_sql('r', 'object_path', 'download_plan', 'files')}
    UNION ALL SELECT 'download_plan', 'files[' || pos || '].plan_index', 'plan_index at position ' || pos || ' is ' || plan_index
    FROM (SELECT plan_index, row_number() OVER (ORDER BY idx) - 1 AS pos FROM r) WHERE plan_index <> pos"""
    ),
)
def download_plan_rules(spark, d):
    return rules.plan_rules(raw_files(spark, d))


DOWN = f"""{RAW}, w AS (SELECT idx, object_uri, object_path, size_bytes, 'raw/' || CASE WHEN idx % 19 = 4 THEN 'same' ELSE idx::VARCHAR END AS local_path,
  CASE WHEN idx % 6 = 0 THEN 'failed' ELSE 'downloaded' END AS status,
  size_bytes + CASE WHEN idx % 25 = 0 THEN 1 ELSE 0 END AS bytes_transferred,
  CASE WHEN idx % 4 = 0 THEN NULL WHEN idx % 33 = 1 THEN 'xyz' ELSE sha256(idx::VARCHAR) END AS sha256,
  CASE WHEN idx % 12 = 0 THEN 'lost' WHEN idx % 10 = 3 THEN ' ' END AS error FROM r)"""


def downloads(spark, d):
    i = F.col("idx")
    return raw_files(spark, d).select(
        "idx", "object_uri", "object_path", "size_bytes",
        F.concat(F.lit("raw/"), F.when(i % 19 == 4, "same").otherwise(i.cast("string"))).alias("local_path"),
        F.when(i % 6 == 0, "failed").otherwise("downloaded").alias("status"),
        (F.col("size_bytes") + (i % 25 == 0).cast("bigint")).alias("bytes_transferred"),
        F.when(i % 4 == 0, F.lit(None)).when(i % 33 == 1, "xyz").otherwise(F.sha2(i.cast("string"), 256)).alias("sha256"),
        F.when(i % 12 == 0, "lost").when(i % 10 == 3, " ").alias("error"),
    )


@reg.add(
    "downloaded_file_rules",
    hinted(
    f"""WITH {DOWN} {_local_sql('downloaded_files', src='w')}
    UNION ALL {_dup_sql('w', 'object_uri', 'downloaded_files', 'files')} UNION ALL {_dup_sql('w', 'object_path', 'downloaded_files', 'files')}
    UNION ALL {_dup_sql('w', 'local_path', 'downloaded_files', 'files')}
    UNION ALL SELECT 'downloaded_files', 'files[' || idx || '].sha256', 'sha256 is not 64 hexadecimal digits' FROM w WHERE sha256 = 'xyz'
    UNION ALL SELECT 'downloaded_files', 'files[' || idx || '].bytes_transferred',
      bytes_transferred || ' bytes transferred of a file of ' || size_bytes FROM w WHERE bytes_transferred > size_bytes
    UNION ALL SELECT 'downloaded_files', 'files[' || idx || '].error', CASE WHEN status = 'failed' THEN 'a failed download names no error'
      ELSE 'the error text is blank' END FROM w
      WHERE (status = 'failed' AND coalesce(trim(error), '') = '') OR (status <> 'failed' AND trim(error) = '')"""
    ),
)
def downloaded_file_rules(spark, d):
    return rules.download_rules(downloads(spark, d))


@reg.add("sha256_format", f"WITH {DOWN} SELECT idx, coalesce(NOT regexp_full_match(sha256, '[0-9a-fA-F]{{64}}'), false) AS bad FROM w")
def sha256_format(spark, d):
    return downloads(spark, d).select("idx", F.coalesce(rules.sha256().broken, F.lit(False)).alias("bad"))


@reg.add(
    "duplicate_text_lines",
    """SELECT 'documents' AS kind, 'documents[' || doc_id || '].text' AS location, 'text again: ' || md5(text) AS message
    FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE trim(text) <> '') WHERE nth = 2""",
)
def duplicate_text_lines(spark, d):
    """Whole texts are compared by digest, so the shuffle moves 64 characters per document."""
    docs = views.table(spark, d, "documents").where(F.trim("text") != "").select(
        F.col("doc_id").alias("idx"), F.sha2("text", 256).alias("digest"), F.md5("text").alias("shown")
    )
    where = F.concat(F.lit("documents["), F.col("idx").cast("string"), F.lit("].text"))
    return rules.duplicates(docs, "digest", [F.col("idx")], "documents", where, "text", F.col("shown"))


FRAMES = """fr AS (SELECT event_id AS idx,
  CASE WHEN event_id % 97 = 1 THEN 's_0' ELSE 's_' || event_id END AS sample_id,
  CASE WHEN event_id % 89 = 2 THEN 'seg:bad' ELSE user_id || ':' || printf('%06d', (event_id // 150) % 1000000) END AS frame_id,
  CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
  (event_id // 150)::INTEGER AS frame_index, CASE WHEN event_id % 83 = 0 THEN -1 ELSE epoch_us(ts) END AS timestamp_micros,
  user_id::VARCHAR AS segment_id,
  CASE event_id % 3 WHEN 0 THEN 'Training' WHEN 1 THEN CASE WHEN event_id % 79 = 0 THEN 'valid' ELSE 'val' END ELSE 'testing' END || '/x.parquet' AS object_path,
  CASE WHEN event_id % 73 = 0 THEN '' WHEN event_id % 71 = 0 THEN '../rgb/s_' || event_id || '.bin' WHEN event_id % 67 = 0 THEN 'rgb/other.bin' ELSE 'rgb/s_' || event_id || '.bin' END AS rgb_path,
  CASE WHEN event_id % 61 = 0 THEN 'rgb/s_' || event_id || '.bin' ELSE 'range/s_' || event_id || '.bin' END AS range_path,
  CASE WHEN event_id % 59 = 0 THEN 'other' ELSE 'ext' END AS extractor_name FROM events)"""


def frame_records(spark, d):
    i = F.col("event_id")
    s = i.cast("string")
    index = F.floor(i / 150).cast("int")
    rgb = F.concat(F.lit("rgb/s_"), s, F.lit(".bin"))
    folder = F.when(i % 3 == 0, "Training").when(i % 3 == 1, F.when(i % 79 == 0, "valid").otherwise("val")).otherwise("testing")
    return views.array_table(spark, d, "events", "event_id").select(
        i.alias("idx"),
        F.when(i % 97 == 1, "s_0").otherwise(F.concat(F.lit("s_"), s)).alias("sample_id"),
        F.when(i % 89 == 2, "seg:bad").otherwise(F.format_string("%d:%06d", "user_id", index)).alias("frame_id"),
        F.when(i % 3 == 0, "train").when(i % 3 == 1, "val").otherwise("test").alias("split"),
        index.alias("frame_index"), F.when(i % 83 == 0, -1).otherwise(views.micros(F.col("ts"))).alias("timestamp_micros"),
        F.col("user_id").cast("string").alias("segment_id"), F.lit(None).cast("string").alias("object_uri"),
        F.concat(folder, F.lit("/x.parquet")).alias("object_path"), F.lit(None).cast("string").alias("local_path"),
        F.when(i % 73 == 0, "").when(i % 71 == 0, F.concat(F.lit("../"), rgb)).when(i % 67 == 0, "rgb/other.bin").otherwise(rgb).alias("rgb_path"),
        F.when(i % 61 == 0, rgb).otherwise(F.concat(F.lit("range/s_"), s, F.lit(".bin"))).alias("range_path"),
        F.when(i % 59 == 0, "other").otherwise("ext").alias("extractor_name"), F.lit("1").alias("extractor_version"),
        F.lit(None).cast("string").alias("config_hash"), F.lit(None).cast("string").alias("command"),
    )


@reg.add(
    "frame_contract",
    hinted(
    f"""WITH {FRAMES}, d AS (
    SELECT 'frames[' || idx || '].timestamp_micros' AS location, 'timestamp_micros is negative' AS message FROM fr WHERE timestamp_micros < 0
    UNION ALL SELECT 'frames[' || idx || '].frame_id', 'frame_id does not follow from segment and index: ' || segment_id || ':' || printf('%06d', frame_index) || ' is not ' || frame_id
      FROM fr WHERE frame_id <> segment_id || ':' || printf('%06d', frame_index)
    UNION ALL SELECT 'frames[' || idx || '].object_path', 'path names no folder of its split (val or validation)' FROM fr WHERE object_path = 'valid/x.parquet'
    UNION ALL SELECT 'frames[' || idx || '].rgb_path', 'frame has no rgb file' FROM fr WHERE rgb_path = ''
    UNION ALL SELECT 'frames[' || idx || '].artifacts', 'rgb and range share one file' FROM fr WHERE rgb_path = range_path
    UNION ALL SELECT 'frames[' || idx || '].rgb_path', 'path leaves the dataset folder' FROM fr WHERE rgb_path LIKE '../%'
    UNION ALL SELECT 'frames[' || idx || '].rgb_path', 'rgb file lies outside rgb' FROM fr WHERE rgb_path LIKE '../%'
    UNION ALL SELECT 'frames[' || idx || '].range_path', 'range file lies outside range' FROM fr WHERE range_path LIKE 'rgb/%'
    UNION ALL SELECT 'frames[' || idx || '].rgb_path', 'rgb file is not named after sample ' || sample_id FROM fr
      WHERE rgb_path <> '' AND regexp_replace(regexp_replace(rgb_path, '.*/', ''), '[.]bin$', '') <> sample_id
    UNION ALL SELECT 'frames[' || idx || '].range_path', 'range file is not named after sample ' || sample_id FROM fr
      WHERE regexp_replace(regexp_replace(range_path, '.*/', ''), '[.]bin$', '') <> sample_id
    UNION ALL SELECT 'frames[' || idx || '].provenance', 'made by another extractor than the first frame' FROM fr
      WHERE extractor_name <> (SELECT min_by(extractor_name, idx) FROM fr)
    UNION ALL SELECT 'frames[' || idx || '].' || field, 'artifact path again: ' || path FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx, slot) AS nth FROM (
      SELECT idx, 0 AS slot, 'rgb_path' AS field, rgb_path AS path FROM fr UNION ALL SELECT idx, 1, 'range_path', range_path FROM fr) WHERE path <> '') WHERE nth = 2
    UNION ALL SELECT 'frames[' || idx || '].sample_id', 'sample_id again: ' || sample_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY idx) AS nth FROM fr) WHERE nth = 2
    UNION ALL SELECT 'frames[' || idx || '].frame_id', 'frame_id again: ' || frame_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY idx) AS nth FROM fr) WHERE nth = 2
    UNION ALL SELECT 'frames[' || idx || '].frame_index', 'segment and frame index again: ' || segment_id || '#' || frame_index
      FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, frame_index ORDER BY idx) AS nth FROM fr) WHERE nth = 2)
    SELECT 'extracted_frames' AS kind, location, message FROM d"""
    ),
)
def frame_contract(spark, d):
    return rules.frame_contract(frame_records(spark, d), "rgb", "range")


def sample_records(spark, d):
    i = F.col("vec_id")
    s = i.cast("string")
    preview = F.struct(F.lit("rgb").alias("kind"), F.concat(F.lit("preview/rgb/v_"), s, F.lit(".png")).alias("path"))
    wrong = F.struct(F.lit("range").alias("kind"), F.concat(F.lit("preview/rgb/v_"), s, F.lit(".png")).alias("path"))
    return views.table(spark, d, "embeddings").select(
        i.alias("idx"), F.concat(F.lit("v_"), s).alias("sample_id"), F.concat(F.lit("v_"), s).alias("source_sample_id"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("f_"), s)).alias("frame_id"),
        F.concat(F.lit("rgb/v_"), s, F.lit(".bin")).alias("rgb_path"),
        F.when(i % 11 == 0, F.array(F.lit(3), F.lit(4))).when(i % 17 == 0, F.array(F.lit(4), F.lit(0), F.lit(4))).otherwise(F.array(F.lit(3), F.lit(4), F.lit(4))).alias("rgb_shape"),
        F.lit("chw").alias("rgb_layout"),
        F.concat(F.lit("range/v_"), s, F.lit(".bin")).alias("range_path"),
        F.array(F.lit(8), F.lit(8)).alias("range_shape"), F.when(i % 7 == 0, "chw").otherwise("hw").alias("range_layout"),
        i.alias("timestamp_micros"), F.concat(F.lit("seg"), F.col("label").cast("string")).alias("segment_id"),
        F.floor(i / 2).cast("int").alias("frame_index"),
        F.when(i % 19 == 0, F.array().cast("array<struct<kind:string,path:string>>")).when(i % 23 == 0, F.array(preview, wrong)).otherwise(F.array(preview)).alias("previews"),
    )


@reg.add(
    "sample_contract",
    hinted(
    """WITH e AS (SELECT vec_id AS idx, label, vec_id // 2 AS fi FROM embeddings), d AS (
    SELECT 'samples[' || idx || '].frame_id' AS location, 'frame_id is blank' AS message FROM e WHERE idx % 13 = 0
    UNION ALL SELECT 'samples[' || idx || '].rgb_shape', 'shape has a dimension below one' FROM e WHERE idx % 17 = 0 AND idx % 11 <> 0
    UNION ALL SELECT 'samples[' || idx || '].rgb_shape', 'rgb shape does not fit its layout: [' || CASE WHEN idx % 11 = 0 THEN '3, 4' ELSE '4, 0, 4' END || '] with chw' FROM e WHERE idx % 11 = 0 OR idx % 17 = 0
    UNION ALL SELECT 'samples[' || idx || '].range_shape', 'range shape does not fit its layout: [8, 8] with chw' FROM e WHERE idx % 7 = 0
    UNION ALL SELECT 'samples[' || idx || '].previews', 'sample has no preview' FROM e WHERE idx % 19 = 0
    UNION ALL SELECT 'samples[' || idx || '].preview_path', 'preview lies outside preview/range/' FROM e WHERE idx % 23 = 0 AND idx % 19 <> 0
    UNION ALL SELECT 'samples[' || idx || '].previews[1].path', 'artifact path again: preview/rgb/v_' || idx || '.png' FROM e WHERE idx % 23 = 0 AND idx % 19 <> 0
    UNION ALL SELECT 'samples[' || idx || '].frame_index', 'segment and frame index again: seg' || label || '#' || fi FROM (SELECT *, row_number() OVER (PARTITION BY label, fi ORDER BY idx) AS nth FROM e) WHERE nth = 2)
    SELECT 'processed_samples' AS kind, location, message FROM d"""
    ),
)
def sample_contract(spark, d):
    return rules.sample_contract(sample_records(spark, d), "rgb", "range", "preview")


@reg.add(
    "run_rules",
    hinted(
    """WITH r AS (SELECT o_orderkey AS idx, 'run-' || CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE o_orderkey END AS run_id,
      CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
      o_orderdate AS s, CASE WHEN o_orderkey % 7 < 5 THEN o_orderdate + INTERVAL (CASE WHEN o_orderkey % 50 = 3 THEN -1 ELSE 1 END) DAY END AS e FROM orders)
    SELECT 'run_index' AS kind, 'runs[' || idx || '].finished_at' AS location, 'run ends before it starts' AS message FROM r WHERE e < s
    UNION ALL SELECT 'run_index', 'runs[' || idx || '].finished_at', 'open run has an end time' FROM r WHERE status IN ('pending', 'running') AND e IS NOT NULL
    UNION ALL SELECT 'run_index', 'runs[' || idx || '].finished_at', 'closed run has no end time' FROM r WHERE status IN ('succeeded', 'failed', 'cancelled') AND e IS NULL
    UNION ALL SELECT 'run_index', 'runs[' || idx || '].run_id', 'run_id again: ' || run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS nth FROM r) WHERE nth = 2"""
    ),
)
def run_rules(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "running").when(k % 5 == 2, "succeeded").when(k % 5 == 3, "failed").otherwise("cancelled")
    runs = views.table(spark, d, "orders").select(
        k.alias("idx"), F.concat(F.lit("run-"), F.when(k % 40 == 0, "0").otherwise(k.cast("string"))).alias("run_id"),
        F.lit("runs").alias("output_dir"), state.alias("status"), F.col("o_orderdate").alias("started_at"),
        F.when(k % 7 < 5, F.col("o_orderdate") + F.make_dt_interval(F.when(k % 50 == 3, -1).otherwise(1))).alias("finished_at"),
    )
    return rules.run_rules(runs)


@reg.add(
    "latest_reference_rules",
    hinted(
    """WITH r AS (SELECT s_suppkey AS idx, 'ref_' || s_suppkey AS name, CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 8 = 1 THEN 'manifests/shared.json' ELSE 'manifests/' || s_name || '.json' END AS p, s_nationkey % 3 AS v FROM supplier)
    SELECT 'latest' AS kind, name || '.manifest_path' AS location, 'manifest_path is blank' AS message FROM r WHERE p = ''
    UNION ALL SELECT 'latest', name || '.schema_version', 'reference should have schema version ' || CASE WHEN idx < 20 THEN '1' ELSE 'none' END || ', has ' || v FROM r WHERE idx >= 20 OR v <> 1
    UNION ALL SELECT 'latest', name || '.manifest_path', 'manifest_path again: ' || p FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY idx) AS nth FROM r WHERE p <> '') WHERE nth = 2"""
    ),
)
def latest_reference_rules(spark, d):
    k = F.col("s_suppkey")
    refs = views.table(spark, d, "supplier").select(
        k.alias("idx"), F.concat(F.lit("ref_"), k.cast("string")).alias("name"),
        F.when(k % 9 == 0, "").when(k % 8 == 1, "manifests/shared.json").otherwise(F.concat(F.lit("manifests/"), F.col("s_name"), F.lit(".json"))).alias("manifest_path"),
        (F.col("s_nationkey") % 3).alias("schema_version"),
    )
    return rules.latest_rules(refs, {f"ref_{i}": 1 for i in range(20)})


@reg.add(
    "extraction_count_rules",
    hinted(
    """WITH u AS (SELECT user_id AS idx, count(*) FILTER (event_type = 'view') AS c, count(*) FILTER (event_type = 'click') AS l, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY 1)
    SELECT 'extraction_summary' AS kind, 'files[' || idx || '].matched_pairs' AS location, 'more pairs than camera_frames' AS message FROM u WHERE m > c
    UNION ALL SELECT 'extraction_summary', 'files[' || idx || '].matched_pairs', 'more pairs than lidar_frames' FROM u WHERE m > l"""
    ),
)
def extraction_count_rules(spark, d):
    t = F.col("event_type")
    rows = views.table(spark, d, "events").groupBy(F.col("user_id").alias("idx")).agg(
        F.count_if(t == "view").alias("camera_frames"), F.count_if(t == "click").alias("lidar_frames"), F.count_if(t == "error").alias("matched_pairs")
    )
    return rules.extraction_rules(rows)


@reg.add(
    "artifact_bytes",
    hinted(
    """WITH b AS (SELECT doc_id AS idx, octet_length(encode(text)) AS len, sha256(text) AS h FROM documents)
    SELECT 'artifacts' AS kind, 'refs[' || idx || '].path' AS location, 'no such file: doc_' || idx AS message FROM b WHERE idx % 21 = 0
    UNION ALL SELECT 'artifacts', 'refs[' || idx || '].shape', 'shape needs ' || (len + 2) || ' bytes, file has ' || len FROM b WHERE idx % 21 <> 0 AND idx % 16 = 1
    UNION ALL SELECT 'artifacts', 'refs[' || idx || '].size_bytes', 'record says ' || (len + 1) || ' bytes, file has ' || len FROM b WHERE idx % 21 <> 0 AND idx % 15 = 2
    UNION ALL SELECT 'artifacts', 'refs[' || idx || '].sha256', 'stored bytes have another sha256' FROM b WHERE idx % 21 <> 0 AND idx % 14 = 3"""
    ),
)
def artifact_bytes(spark, d):
    """Texts stand in for stored tensor files: their whole bytes are measured and hashed."""
    docs = views.table(spark, d, "documents")
    i, size = F.col("doc_id"), F.octet_length("text")
    path = F.concat(F.lit("doc_"), i.cast("string"))
    refs = docs.select(
        i.alias("idx"), path.alias("path"), F.array(size + F.when(i % 16 == 1, 2).otherwise(0)).alias("dims"), F.lit("u8").alias("dtype"),
        F.when(i % 5 != 0, size + F.when(i % 15 == 2, 1).otherwise(0)).alias("size_bytes"),
        F.when(i % 14 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("sha256"),
    )
    stored = docs.where("doc_id % 21 <> 0").select(path.alias("path"), size.alias("length"), F.col("text").cast("binary").alias("content"))
    return rules.artifact_bytes(refs, stored)


@reg.add(
    "suspicious_samples",
    """SELECT count(*) FILTER (vec_id % 20 = 0) AS missing_files, count(*) FILTER (vec_id % 20 = 1) AS wrong_tensor_size,
    count(*) FILTER (vec_id % 20 = 2) AS non_finite_values,
    count(*) FILTER (vec_id % 20 > 1 AND len(list_filter(list_transform(embedding[1:48], lambda e: e * 1.9), lambda v: v < -1 OR v > 1)) > 0) AS rgb_out_of_range,
    count(*) FILTER (vec_id % 20 > 1 AND (vec_id % 20 = 2 OR len(list_filter(embedding, lambda e: e < 0)) > 0) AND vec_id % 20 <> 3) AS range_out_of_range,
    count(*) FILTER (vec_id % 20 = 3) AS low_valid_fraction FROM embeddings""",
)
def suspicious_samples(spark, d):
    i = F.col("vec_id")
    e = F.transform("embedding", lambda v: v.cast("double"))
    rgb = F.transform(F.slice(e, 1, 48), lambda v: (v * 1.9 + 1) / 2)
    zeros = F.transform(e, lambda _: F.lit(0.0))
    spiked = F.transform(e, lambda v, k: F.when(k == 5, F.lit(float("inf"))).otherwise(v))
    rng = F.when(i % 20 == 1, F.slice(e, 1, 10)).when(i % 20 == 2, spiked).when(i % 20 == 3, zeros).otherwise(e)
    samples = views.table(spark, d, "embeddings").select(rgb.alias("rgb"), F.when(i % 20 != 0, rng).alias("range"))
    return rules.suspicious(samples, 48, 64, 64)


@reg.add(
    "probe_matrix_rules",
    hinted(
    """WITH e AS (SELECT vec_id AS idx, CASE vec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'eval' ELSE 'train' END AS part FROM embeddings)
    SELECT 'probe' AS kind, part || '_features[' || idx || ']' AS location, 'row is wider than the narrowest of its part' AS message FROM e WHERE idx % 31 = 0
    UNION ALL SELECT 'probe', part || '_features[' || idx || ']', 'a value is not finite' FROM e WHERE idx % 37 = 0 AND idx % 31 <> 0
    UNION ALL SELECT 'probe', part || '_presence[' || idx || ']', 'a value is neither 0 nor 1' FROM e WHERE idx % 41 = 0
    UNION ALL SELECT 'probe', part || '_class_names', '3 class names for targets of width 10' FROM (SELECT DISTINCT part FROM e)"""
    ),
)
def probe_matrix_rules(spark, d):
    rows = views.probe_rows(views.table(spark, d, "embeddings"))
    i = F.col("idx")
    broken = rows.withColumns(
        {
            "features": F.when(i % 31 == 0, F.concat("features", F.array(F.lit(0.0))))
            .when(i % 37 == 0, F.transform("features", lambda v, k: F.when(k == 0, F.lit(float("nan"))).otherwise(v)))
            .otherwise(F.col("features")),
            "presence": F.when(i % 41 == 0, F.transform("presence", lambda v: (v + 2).cast("tinyint"))).otherwise(F.col("presence")),
        }
    )
    return rules.probe_rules(broken, class_names=["a", "b", "c"])


@reg.add(
    "split_table_rules",
    hinted(
    """SELECT 'splits' AS kind, 'assignments[' || doc_id || '].sample_id' AS location, 'sample_id is blank' AS message FROM documents WHERE doc_id % 99 = 0
    UNION ALL SELECT 'splits', 'assignments[' || doc_id || '].sample_id', 'sample_id again: ' || source FROM
    (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 99 <> 0) WHERE nth = 2"""
    ),
)
def split_table_rules(spark, d):
    """Sources repeat often, so most of the table is one of a few values: only two rows per value leave a task."""
    rows = views.table(spark, d, "documents").select(
        F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 99 == 0, " ").otherwise(F.col("source")).alias("sample_id")
    )
    return rules.split_rules(rows)


@reg.add(
    "schema_version_rules",
    hinted(
    """SELECT 'tables' AS kind, 'tables[' || o_orderkey || '].schema_version' AS location,
    'schema version should be 1, is ' || CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE (o_orderkey % 3)::VARCHAR END AS message
    FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 <> 1"""
    ),
)
def schema_version_rules(spark, d):
    k = F.col("o_orderkey")
    tables = views.table(spark, d, "orders").select(k.alias("idx"), F.when(k % 7 != 0, k % 3).alias("schema_version"))
    return rules.version_rules(tables, 1)
