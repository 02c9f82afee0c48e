"""Versioned JSON tables, epoch metrics, corrupt-record reports and binary tensor files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Storage types of tensor files.
DTYPES = {"f32": "<f4", "f16": "<f2", "u8": "u1"}
DTYPE_BYTES = {"f32": 4, "f16": 2, "u8": 1}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, version: int) -> DataFrame:
    """A JSON-lines table whose every row carries the expected ``schema_version``; another version raises on read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # a filter is never pruned, so a plain count is checked too
    return df.where(_checked_version(F.col("schema_version"), version))


def _checked_version(found: Column, version: int) -> Column:
    return F.when(found == version, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected schema version {version}, found "), F.coalesce(found.cast("string"), F.lit("none")))).cast(
            "boolean"
        )
    )


def write_table(df: DataFrame, path: str, version: int) -> None:
    """Write rows as JSON with their schema version; Spark's committer makes the write atomic per job."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(path)


def epoch_metrics(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Per-epoch JSON lines; blank lines are skipped, a malformed line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corrupt_rows(spark: SparkSession, path: str, schema: T.StructType | str, version: int) -> DataFrame:
    """Malformed lines and rows of another version, as diagnostics instead of failures."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    raw = spark.read.text(path).where(F.trim("value") != "")
    ddl = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select(
        "value", F.col("_metadata.file_name").alias("file_name"),
        F.from_json("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    return corruption_diagnostics(parsed, version)


def corruption_diagnostics(parsed: DataFrame, version: int) -> DataFrame:
    """Diagnostics for rows ``(file_name, value, r)`` where ``r`` is the parsed record."""
    broken = F.col("r._corrupt_record").isNotNull()
    found = F.col("r.schema_version")
    wrong = ~broken & (found.isNull() | (found != version))
    return parsed.where(broken | wrong).select(
        F.when(broken, "malformed").otherwise("version_mismatch").alias("kind"),
        F.col("file_name").alias("location"),
        F.when(broken, F.lit("record is not valid JSON for this table"))
        .otherwise(
            F.concat(F.lit(f"expected schema version {version}, found "), F.coalesce(found.cast("string"), F.lit("none")))
        )
        .alias("message"),
        F.when(broken, F.lit("Regenerate the table or remove the damaged record."))
        .otherwise(F.lit("Regenerate the table with the current writer."))
        .alias("hint"),
    )


def decode(content: Column, dtype: str = "f32") -> Column:
    """Little-endian bytes to ``array<float>``. Spark SQL has no float-bits decoder, so bytes go through Arrow."""
    import numpy as np

    code, width = DTYPES[dtype], DTYPE_BYTES[dtype]

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        def one(blob):
            if blob is None:
                return None
            return np.frombuffer(blob, dtype=code).astype(np.float32)

        return blobs.map(one)

    torn = (F.octet_length(content) % width) != 0
    return unpack(F.when(torn, F.raise_error(F.lit(f"byte length is not a multiple of {width}"))).otherwise(content))


def tensor_files(spark: SparkSession, path: str, dtype: str = "f32") -> DataFrame:
    """Binary tensor files as rows ``path, length, values``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", decode(F.col("content"), dtype).alias("values"))
