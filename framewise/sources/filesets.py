"""File lists: listings, pairing by name, companions, selection per split and fetch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.ordered import first_k, first_per_key, running
from framewise.operators.splits import first_n

# Source split labels, component directories, split tokens and the object-store scheme.
SOURCE_SPLITS = ("training", "validation", "testing")
CAMERA_COMPONENT, BOX_COMPONENT = "camera_image", "camera_box"
SPLIT_TOKENS = {
    "train": ("train", "training"),
    "val": ("val", "valid", "validation"),
    "test": ("test", "testing"),
}
SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}
URI_SCHEME = "gs://"


def listing(lines: DataFrame, split: str, limit: int | None = None, text: str = "value", order: str | None = None) -> DataFrame:
    """Object rows of a long-format listing: ``uri, split, file_name, size_bytes`` in line order."""
    line = F.trim(F.col(text))
    start = F.locate(URI_SCHEME, line)
    uri = F.regexp_extract(F.expr(f"substring(trim(`{text}`), locate('{URI_SCHEME}', trim(`{text}`)))"), r"^(\S+)", 1)
    size = F.regexp_extract(line, r"^\+?(\d+)(?=\s|gs://)", 1).try_cast("bigint")
    keep = ([F.col(order)] if order else [])
    rows = (
        lines.where((line != "") & ~line.startswith("TOTAL:") & (start > 0))
        .select(*keep, uri.alias("uri"), size.alias("size_bytes"))
        .where(~F.col("uri").rlike("[/:]$"))
        .select(
            *keep, "uri", F.lit(split).alias("split"),
            F.substring_index(F.col("uri"), "/", -1).alias("file_name"), "size_bytes",
        )
        .where(F.col("file_name") != "")
    )
    if limit is not None:
        if order is None:
            raise ValueError("a limit needs an order, else the rows are arbitrary")
        rows = first_n(rows, limit, [F.col(order)])
    return rows


def pair_files(camera_files: DataFrame, lidar_files: DataFrame) -> DataFrame:
    """Camera and lidar files with the same name: ``file_name, camera_path, lidar_path``.

    Inputs carry one ``path`` per file; names are unique inside a component directory.
    """
    cams = camera_files.select(_name("path").alias("file_name"), F.col("path").alias("camera_path"))
    lids = lidar_files.select(_name("path").alias("file_name"), F.col("path").alias("lidar_path"))
    return cams.join(lids, "file_name")


def unpaired_files(camera_files: DataFrame, lidar_files: DataFrame) -> DataFrame:
    """Files present on one side only: ``file_name, path, side``."""
    cams = camera_files.select(_name("path").alias("file_name"), "path", F.lit("camera").alias("side"))
    lids = lidar_files.select(_name("path").alias("file_name"), "path", F.lit("lidar").alias("side"))
    return cams.join(lids, "file_name", "left_anti").unionByName(lids.join(cams, "file_name", "left_anti"))


def _name(path: str) -> Column:
    return F.substring_index(F.col(path), "/", -1)


def _parts(uri: Column) -> Column:
    return F.split(uri, "/", 6)


def target_path(out_dir: str) -> Column:
    """Local target ``out/split/component/file``, or ``out/split/file`` when the URI names no component."""
    parts = _parts(F.col("uri"))
    return F.when(
        F.size(parts) == 6, F.concat_ws("/", F.lit(out_dir), F.col("split"), F.get(parts, 4), F.col("file_name"))
    ).otherwise(F.concat_ws("/", F.lit(out_dir), F.col("split"), F.col("file_name")))


def companions(files: DataFrame, components: list[str], out_dir: str, order: str) -> DataFrame:
    """The files plus, for each component, their not yet listed companion, with the local target path.

    A companion swaps the component part of ``scheme://bucket/split/component/rest``; shorter URIs have none.
    """
    parts = _parts(F.col("uri"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(components)])
    extra = (
        files.where(F.size(parts) == 6)
        .withColumn("__to", F.explode(wanted))
        .select(
            *[F.col(c) for c in files.columns if c not in ("uri", "size_bytes")],
            F.concat_ws(
                "/", F.slice(parts, 1, 4), F.col("__to")["c"], F.get(parts, 5)
            ).alias("uri"),
            F.lit(None).cast("bigint").alias("size_bytes"),
            (F.col("__to")["i"] + 1).alias("pass"),
        )
    )
    everything = files.withColumn("pass", F.lit(0)).unionByName(extra)
    unique = first_per_key(everything, ["uri"], F.struct(F.col("pass"), F.col(order)))
    return unique.withColumn("target_path", target_path(out_dir))


def box_path(camera_path: Column) -> Column:
    """The box file next to a camera file: its component directory is swapped, in any letter case."""
    return F.regexp_replace(camera_path, rf"(?i)(^|/){CAMERA_COMPONENT}/([^/]+)$", f"$1{BOX_COMPONENT}/$2")


def append_unique(old: DataFrame, new: DataFrame, key: str = "uri", order: str = "seq") -> DataFrame:
    """Old rows, then new rows whose key is not known yet; ``appended`` marks the latter."""
    both = old.withColumn("appended", F.lit(False)).unionByName(new.withColumn("appended", F.lit(True)))
    # every old row stays; among new rows only the first of an unseen key survives
    firsts = first_per_key(both, [key], F.struct(F.col("appended"), F.col(order)))
    return both.where(~F.col("appended")).unionByName(firsts.where("appended"))


def top_per_split(files: DataFrame, counts: dict[str, int], order: str = "seq") -> DataFrame:
    """The first N files of each requested split, in listing order."""
    wanted = _counts(files, counts, "wanted")
    most = max(counts.values(), default=0)
    requested = files.where(F.col("split").isin(list(counts)))
    ranked = first_k(requested, ["split"], [F.col(order)], most, rank="split_rank")
    return ranked.join(F.broadcast(wanted), "split").where(F.col("split_rank") <= F.col("wanted")).drop("wanted")


def _counts(df: DataFrame, counts: dict[str, int], name: str) -> DataFrame:
    rows = [(k, int(v)) for k, v in counts.items()]
    return df.sparkSession.createDataFrame(rows, f"split string, {name} bigint")


def shortfall(files: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Requested splits with fewer files than asked for: ``split, wanted, selected``."""
    have = files.where(F.col("split").isin(list(counts))).groupBy("split").agg(F.count(F.lit(1)).alias("available"))
    return (
        _counts(files, counts, "wanted")
        .join(have, "split", "left")
        .select("split", "wanted", F.least("wanted", F.coalesce("available", F.lit(0))).alias("selected"))
        .where(F.col("selected") < F.col("wanted"))
    )


def infer_split(path: Column) -> Column:
    """Split named by the first recognised component of a path, or NULL."""
    pairs = [F.lit(x) for split, tokens in SPLIT_TOKENS.items() for t in tokens for x in (t, split)]
    table = F.create_map(*pairs)
    named = F.transform(F.split(F.lower(path), "/"), lambda part: F.try_element_at(table, part))
    return F.get(F.filter(named, lambda s: s.isNotNull()), F.lit(0))


def fetch_plan(
    files: DataFrame, targets: dict[str, int | None] | None = None, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Plan rows with contiguous ``plan_index`` (train, val, test; path, uri), and warning rows.

    Input: ``object_uri, object_path, size_bytes``. Targets cut each split, then ``limit`` cuts the whole plan.
    """
    targets = targets or {}
    split = F.coalesce(infer_split(F.col("object_path")), infer_split(F.col("object_uri")))
    known = files.withColumn("split", split)
    placed = known.where(F.col("split").isNotNull())
    order = [F.col("object_path"), F.col("object_uri")]
    caps = [targets.get(s) for s in SPLIT_ORDER]
    if all(c is not None for c in caps):
        ranked = first_k(placed, ["split"], order, max(caps), rank="split_rank")
    elif limit is not None:
        ranked = first_k(placed, ["split"], order, limit, rank="split_rank")
    else:
        ranked = running(placed, ["split"], order, rank="split_rank")

    available = placed.groupBy("split").agg(F.count(F.lit(1)).alias("available"))
    spark = files.sparkSession
    asked = spark.createDataFrame(
        [(s, i, targets.get(s)) for s, i in SPLIT_ORDER.items()], "split string, split_order int, requested bigint"
    )
    # three rows, one per split
    budget = (
        asked.join(available, "split", "left")
        .withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
        .withColumn("take", F.least(F.coalesce("requested", "available"), "available"))
    )
    earlier = Window.orderBy("split_order").rowsBetween(Window.unboundedPreceding, -1)
    offsets = budget.select("split", "take", F.coalesce(F.sum("take").over(earlier), F.lit(0)).alias("offset"))
    plan = (
        ranked.join(F.broadcast(offsets), "split")
        .where(F.col("split_rank") <= F.col("take"))
        .withColumn("plan_index", F.col("offset") + F.col("split_rank") - 1)
        .select("plan_index", "split", "object_uri", "object_path", "size_bytes")
    )
    if limit is not None:
        plan = plan.where(F.col("plan_index") < F.lit(limit))
    unknown = known.where(F.col("split").isNull()).select(
        F.lit(None).cast("string").alias("split"),
        F.lit(None).cast("bigint").alias("requested"),
        F.lit(0).cast("bigint").alias("available"),
        F.concat(F.lit("no split in the path, left out: "), "object_path").alias("message"),
    )
    missing = budget.where(F.col("requested") > F.col("available")).select(
        "split", "requested", "available",
        F.concat(
            F.col("split"), F.lit(": "), F.col("requested").cast("string"), F.lit(" files asked for, "),
            F.col("available").cast("string"), F.lit(" found"),
        ).alias("message"),
    )
    return plan, unknown.unionByName(missing)


def reconcile_sizes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against found bytes: ``verified`` (equal), ``downloaded`` (size unknown) or ``failed`` with a reason.

    ``expected``: ``target_path, file_name, size_bytes``; ``actual``: ``target_path, length``.
    """
    want, have = F.col("size_bytes"), F.col("length")
    return (
        expected.join(actual.select("target_path", "length"), "target_path", "left")
        .withColumn(
            "status",
            F.when(have.isNull(), "failed").when(want.isNull(), "downloaded").when(want == have, "verified").otherwise("failed"),
        )
        .withColumn(
            "error",
            F.when(have.isNull(), F.concat(F.lit("file is not there: "), "file_name")).when(
                want != have,
                F.concat("file_name", F.lit(" has "), have.cast("string"), F.lit(" bytes instead of "), want.cast("string")),
            ),
        )
    )
