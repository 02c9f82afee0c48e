"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.joins import HOT_PARTS, look_up  # noqa: F401  (shared by the text operators)
from framewise.session import remember, shared_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The six ASCII white-space characters as a regular-expression class body.
BLANKS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long, may be null) and ``text`` (null becomes empty); every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def document_shape(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` in their order; the character count is taken again from the text."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*DOCUMENT_COLUMNS)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task builds from one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back; the path is for ``remove_table`` once it is not needed.

    Like a staged table it is deleted by the scope that is open, or by ``release_staged``.
    """
    spark = df.sparkSession
    path = remember(f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_table(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
