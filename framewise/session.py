"""Session helpers: a local session for tests and benches, and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "framewise") -> SparkSession:
    """A single-JVM session; a cluster session is built by the caller and passed in instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` of the session wins; a temporary folder is made only for a local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


#: Paths that were staged outside any scope, and those of the scope that is open in this thread.
_staged: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("staging", default=None)


def remember(path: str) -> str:
    """A path below the shared folder that the open scope, or ``release_staged``, deletes."""
    opened = _scope.get()
    (_staged if opened is None else opened).append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside: it is deleted at the end, when results must have been written or collected."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, own)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


class RoundLog:
    """A table that grows by one folder a round: rows are written once, and readers may ask for all rounds or for one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rounds, self.columns = spark, [], None
        self.path = remember(f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}")

    def add(self, number: int, df: DataFrame) -> None:
        self.columns = df.schema
        df.write.parquet(f"{self.path}/round={number}")
        self.rounds.append(number)

    def rows(self, number: int | None = None) -> DataFrame:
        """All rows with their ``round``, or those of one round; the folder's name is the filter."""
        whole = StructType([*self.columns.fields, StructField("round", IntegerType())])
        df = self.spark.read.schema(whole).option("basePath", self.path).parquet(self.path)
        return df if number is None else df.where(F.col("round") == number)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables staged outside any scope; DataFrames built on them must no longer be used."""
    return _delete(spark, _staged)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    released = 0
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        released += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return released
