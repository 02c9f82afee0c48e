"""Tables laid out so that later work touches only what it must.

``BucketTable``: rows in folders by a hash of their key; an upsert rewrites the folders that new rows hit and no other file.
``write_by_id`` / ``find``: rows sorted by id, with Parquet min / max and Bloom filters, so a look-up reads a few row groups.
``write_bucketed``: tables bucketed alike by a frame key, which join without an exchange; labels live in a narrow sister table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from framewise.operators.ordered import first_per_key
from framewise.session import stage

BUCKET = "bucket"


class BucketTable:
    """A table at ``path`` with one folder for each of ``buckets`` hashes of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType([*schema.fields, StructField(BUCKET, IntegerType())])

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
        table = cls(df.sparkSession, path, key, df.schema, buckets)
        table._write(df, "errorifexists")
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        """One file for each bucket that has rows; with ``overwrite`` only the folders of those buckets change."""
        rows = df.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        writer = rows.write.mode(mode).partitionBy(BUCKET)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path)

    def rows(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _touched(self, new: DataFrame) -> DataFrame:
        """The rows of the buckets that ``new`` hits: at most ``buckets`` numbers come to the driver, and other folders are not read."""
        hit = [r[0] for r in new.select(self._bucket().alias(BUCKET)).distinct().collect()]
        return self._read().where(F.col(BUCKET).isin(hit)).drop(BUCKET) if hit else self._read().where("false").drop(BUCKET)

    def find(self, key_value: object) -> DataFrame:
        """The row of one key, from one folder."""
        at = self.spark.range(1).select(F.lit(key_value).alias(self.key)).select(self._bucket()).first()[0]
        return self._read().where((F.col(BUCKET) == at) & (F.col(self.key) == F.lit(key_value))).drop(BUCKET)

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Rows of ``new`` replace those of their key; with ``order`` the latest of ``new`` for each key.

        What the touched folders will hold is staged first, so a run that fails before the last write has changed nothing.
        """
        latest = stage(first_per_key(new, [self.key], F.col(order), last=True) if order else new)
        old = self._touched(latest).join(latest.select(self.key), self.key, "left_anti")
        self._write(stage(old.unionByName(latest)), "overwrite")

    def append_unique(self, new: DataFrame, order: str) -> int:
        """Adds the first row of each key that is not there yet, in new files only; the number of rows added."""
        first = stage(first_per_key(new, [self.key], F.col(order)))
        fresh = stage(first.join(self._touched(first).select(self.key).distinct(), self.key, "left_anti"))
        self._write(fresh, "append")
        return fresh.count()


def write_by_id(df: DataFrame, path: str, id_col: str = "sample_id", also: tuple[str, ...] = (), group_bytes: int = 8 << 20, ids: int = 1_000_000) -> None:
    """Rows sorted by id over files that follow each other, in row groups of about ``group_bytes``.

    Min and max of the id tell which row group may hold it. ``also`` names further columns to look up by, which no order
    serves: they get Bloom filters, made for ``ids`` values in a file.
    """
    writer = df.repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").option("parquet.block.size", group_bytes)
    for c in (id_col, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", ids)
    writer.parquet(path)


def find(spark: SparkSession, path: str, value: object, column: str = "sample_id") -> DataFrame:
    """The rows with one value; row groups whose statistics or filter rule it out are not read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> None:
    """A table in the catalogue whose files are bucketed and sorted by ``keys``; an older one of this name is replaced."""
    spread = df.repartition(buckets, *keys)
    spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)


def labelled(spark: SparkSession, samples: str, labels: str, keys: list[str]) -> DataFrame:
    """Samples beside their labels, from two tables bucketed alike: neither side is exchanged."""
    return spark.table(samples).join(spark.table(labels), keys, "left")
