"""Queries on deterministic splits, sampling and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewise.functions.arrays import digest
from framewise.functions.hashing import seed_state, split_hash
from framewise.functions.permute import PRIME, Permutation
from framewise.operators import splits
from framewise.plans import views
from framewise.plans.registry import Registry
from framewise.session import remember, shared_dir, stage
from framewise.sinks import layout

reg = Registry()

SEED = 42
RATIOS = (0.8, 0.1, 0.1)
IDS = "ids AS (SELECT doc_id, source, printf('sample_%06d', doc_id) AS sample_id FROM documents)"


def ids(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", "source", F.format_string("sample_%06d", "doc_id").alias("sample_id")
    )


def _hash_sql(column: str, seed: int) -> str:
    """The same hash on 64-bit unsigned integers, with the product split so that it cannot overflow."""
    start = seed_state(seed)
    step = (
        "((((h::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT)"
    )
    bytes_ = f"list_transform(range(1, length({column}) + 1), lambda i: ord(substr({column}, i, 1))::UBIGINT)"
    body = step.replace("h::UHUGEINT", "xor(h, b)::UHUGEINT")
    return f"list_reduce({bytes_}, lambda h, b: {body}, {start}::UBIGINT)"


HASHED = f"{IDS}, hashed AS (SELECT *, {_hash_sql('sample_id', SEED)} AS h FROM ids)"


@reg.add(
    "split_hash",
    f"WITH {HASHED} SELECT sample_id, (h // 4294967296)::BIGINT AS hi, (h % 4294967296)::BIGINT AS lo FROM hashed",
)
def split_hash_values(spark, d):
    return ids(spark, d).select("sample_id", split_hash(F.col("sample_id"), SEED).alias("h")).select("sample_id", "h.hi", "h.lo")


@reg.add(
    "split_sizes",
    """SELECT split, (CASE split WHEN 'train' THEN n - 2 * (n // 10) ELSE n // 10 END)::BIGINT AS n
    FROM (SELECT count(*) AS n FROM documents), (VALUES ('train'), ('val'), ('test')) v(split)""",
)
def split_sizes(spark, d):
    return splits.split_size_table(ids(spark, d), RATIOS)


ASSIGNED = f"""{HASHED}, assigned AS (SELECT sample_id, CASE WHEN rn <= n - 2 * (n // 10) THEN 'train' WHEN rn <= n - n // 10 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT sample_id, row_number() OVER (ORDER BY h, sample_id) AS rn, count(*) OVER () AS n FROM hashed))"""


@reg.add("split_assign", f"WITH {ASSIGNED} SELECT * FROM assigned")
def split_assign(spark, d):
    return splits.assign(ids(spark, d), "sample_id", SEED, RATIOS)


@reg.add(
    "split_enforce",
    f"WITH {ASSIGNED} SELECT doc_id, sample_id, a.split FROM ids JOIN assigned a USING (sample_id)",
)
def split_enforce(spark, d):
    samples = ids(spark, d).select("doc_id", "sample_id", F.lit("train").alias("split"))
    return splits.enforce(samples, splits.assign(samples, "sample_id", SEED, RATIOS)).select("doc_id", "sample_id", "split")


@reg.add("split_counts", f"WITH {ASSIGNED} SELECT split, count(*) AS n FROM assigned GROUP BY 1")
def split_counts(spark, d):
    return splits.counts(splits.assign(ids(spark, d), "sample_id", SEED, RATIOS, check=False))


# largest remainder for shares 1/2, 1/4, 1/4 depends on the group count modulo 4 only
GROUPS = f"""g AS (SELECT DISTINCT user_id::VARCHAR AS segment FROM events),
  gh AS (SELECT segment, {_hash_sql('segment', SEED)} AS h FROM g),
  ga AS (SELECT segment, CASE WHEN rn <= n // 2 + (n % 4 = 1)::INT THEN 'train'
      WHEN rn <= n // 2 + (n % 4 = 1)::INT + n // 4 + (n % 4 IN (2, 3))::INT THEN 'val' ELSE 'test' END AS split
    FROM (SELECT segment, row_number() OVER (ORDER BY h, segment) AS rn, count(*) OVER () AS n FROM gh))"""
HALVES = (0.5, 0.25, 0.25)


def _segments(spark, d):
    return views.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("segment"))


@reg.add("group_holdout", f"WITH {GROUPS} SELECT event_id, user_id::VARCHAR AS segment, split FROM events JOIN ga ON ga.segment = user_id::VARCHAR")
def group_holdout(spark, d):
    return splits.assign_groups(_segments(spark, d), "segment", SEED, HALVES).select("event_id", "segment", "split")


@reg.add(
    "group_holdout_leakage",
    f"""WITH {GROUPS}, x AS (SELECT ga.segment, count(DISTINCT split) > 1 AS crosses FROM events JOIN ga ON ga.segment = user_id::VARCHAR GROUP BY 1)
    SELECT bool_or(crosses) AS leakage_detected, avg(crosses::INT) AS overlap_fraction, count(*) FILTER (crosses) AS overlapping_groups FROM x""",
)
def group_holdout_leakage(spark, d):
    held = splits.assign_groups(_segments(spark, d), "segment", SEED, HALVES)
    return splits.leakage(held, "segment")


@reg.add(
    "split_leakage",
    """WITH a AS (SELECT source, CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents),
    g AS (SELECT source, count(DISTINCT split) > 1 AS x FROM a GROUP BY 1)
    SELECT bool_or(x) AS leakage_detected, round(avg(x::INT), 6) AS overlap_fraction, count(*) FILTER (x) AS overlapping_groups FROM g""",
)
def split_leakage(spark, d):
    i = F.col("doc_id")
    split = F.when(i % 10 == 0, "val").when(i % 10 == 1, "test").otherwise("train")
    out = splits.leakage(ids(spark, d).withColumn("split", split), "source")
    return out.withColumn("overlap_fraction", F.round("overlap_fraction", 6))


@reg.add("split_filter", """SELECT vec_id, 'val' AS split FROM embeddings WHERE vec_id % 10 = 0""")
def split_filter(spark, d):
    tens = views.tensors(views.table(spark, d, "embeddings"))
    return splits.only(tens, "Validation").select("vec_id", "split")


@reg.add(
    "ordered_batches",
    f"""WITH {IDS} SELECT sample_id, (rn // 64)::BIGINT AS batch_index, (rn % 64)::INT AS position
    FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS rn FROM ids)""",
)
def ordered_batches(spark, d):
    return splits.batches(ids(spark, d).select("sample_id"), "sample_id", 64)


@reg.add(
    "seeded_batches",
    """SELECT (SELECT count(*) FROM documents) AS samples, count(*) AS batches, sum(n)::BIGINT AS placed, max(n)::BIGINT AS largest,
    (SELECT sum(doc_id)::BIGINT FROM documents) AS id_sum FROM
    (SELECT rn // 64 AS b, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS rn FROM documents) GROUP BY 1)""",
)
def seeded_batches(spark, d):
    """The shuffle order is ours, so what is compared is that every row lands in exactly one full batch."""
    shuffled = splits.batches(ids(spark, d).select("doc_id", "sample_id"), "sample_id", 64, seed=SEED, epoch=1)
    per_batch = shuffled.groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("s"), F.count_distinct("doc_id").alias("u")
    )
    return per_batch.agg(
        F.sum("u").alias("samples"), F.count(F.lit(1)).alias("batches"), F.sum("n").alias("placed"),
        F.max("n").alias("largest"), F.sum("s").alias("id_sum"),
    )


def _rounds_sql(source: str, keys: list[tuple[int, int]]) -> str:
    """One pass of the permutation: ``id, x`` of ``source`` to ``id, x``."""
    out = f"SELECT id, x // b AS l, x % b AS r FROM {source}, size"
    for i, (factor, summand) in enumerate(keys):
        digit, other, whole = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        m = f"(({digit} % {PRIME}) * {factor} + {summand}) % {PRIME}"
        moved = f"({other} + (xor({m}, ({m}) >> 15) * 48271) % {PRIME}) % {whole} AS {other}"
        out = f"SELECT id, {moved}, {digit} FROM ({out}), size"
    return f"SELECT id, l * b + r AS x FROM ({out}), size"


EPOCHS = (1, 2)


def _shuffle_sql(epoch: int) -> str:
    keys = Permutation.round_keys(SEED + epoch)
    return f"""(WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS a FROM documents)),
      start AS (SELECT doc_id AS id, row_number() OVER (ORDER BY printf('sample_%06d', doc_id)) - 1 AS x FROM documents),
      walk AS ({_rounds_sql('start', keys)} UNION ALL {_rounds_sql('(SELECT walk.* FROM walk, size WHERE x >= n)', keys)})
      SELECT {epoch} AS epoch, id AS doc_id, x // 64 AS batch_index, (x % 64)::INT AS position FROM walk, size WHERE x < n)"""


@reg.add("permuted_batches", " UNION ALL ".join(f"SELECT * FROM {_shuffle_sql(e)}" for e in EPOCHS))
def permuted_batches(spark, d):
    """Two epochs over rows that were numbered once."""
    named = ids(spark, d).select("doc_id", "sample_id")
    rows, n = stage(splits.numbered(named, "sample_id")), named.count()
    epochs = [splits.shuffled(rows, n, 64, SEED, e).select(F.lit(e).alias("epoch"), "doc_id", "batch_index", "position") for e in EPOCHS]
    return epochs[0].unionByName(epochs[1])


@reg.add("one_batch", f"SELECT doc_id, batch_index, position FROM {_shuffle_sql(1)} WHERE batch_index = (SELECT count(*) // 128 FROM documents)")
def one_batch(spark, d):
    """The batch in the middle of an epoch, asked for alone."""
    named = ids(spark, d).select("doc_id", "sample_id")
    n = named.count()
    return splits.one_batch(splits.numbered(named, "sample_id"), n, 64, SEED, 1, n // 128).select("doc_id", "batch_index", "position")


@reg.add(
    "full_batches",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY printf('sample_%06d', doc_id)) - 1 AS rn FROM documents)
    SELECT doc_id, rn // 64 AS batch_index, (rn % 64)::INT AS position FROM r WHERE rn // 64 < (SELECT count(*) // 64 FROM documents)""",
)
def full_batches(spark, d):
    """The last batch is left out unless it is full."""
    named = views.table(spark, d, "documents").select("doc_id", F.format_string("sample_%06d", "doc_id").alias("sample_id"))
    return splits.batches(named, "sample_id", 64, drop_last=True).select("doc_id", "batch_index", "position")


@reg.add("sample_by_id", "SELECT doc_id, source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def sample_by_id(spark, d):
    """The sample of the highest id, looked up by its name in all samples."""
    named = views.table(spark, d, "documents").withColumn("sample_id", F.format_string("sample_%06d", "doc_id"))
    wanted = named.agg(F.max("sample_id")).first()[0]
    return splits.by_id(named, wanted).select("doc_id", "source")


@reg.add("sample_by_id_sorted", "SELECT doc_id, source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def sample_by_id_sorted(spark, d):
    """The same look-up in a table sorted by id, whose statistics and Bloom filters name the row groups to read."""
    named = views.table(spark, d, "documents").select("doc_id", "source", F.format_string("sample_%06d", "doc_id").alias("sample_id"))
    path = remember(f"{shared_dir(spark).rstrip('/')}/samples-{uuid.uuid4().hex}")
    layout.write_by_id(named, path)
    wanted = spark.read.parquet(path).agg(F.max("sample_id")).first()[0]
    return layout.find(spark, path, wanted).select("doc_id", "source")


@reg.add(
    "batch_assembly",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY printf('sample_%06d', vec_id)) - 1 AS rn FROM embeddings),
    b AS (SELECT rn // 16 AS batch_index, count(*)::INT AS rows, flatten(list(embedding ORDER BY rn)) AS v FROM r GROUP BY 1)
    SELECT batch_index, rows, 8 AS height, len(v) AS n, round(list_sum(list_transform(v, lambda e: e::DOUBLE)), 6) + 0.0 AS total,
    round(list_sum(list_transform(v, lambda e, i: e::DOUBLE * i)), 5) + 0.0 AS weighted FROM b""",
)
def batch_assembly(spark, d):
    tens = views.tensors(views.table(spark, d, "embeddings")).select(
        "sample_id", "embedding", F.array(F.lit(1), F.lit(8), F.lit(8)).alias("shape")
    )
    out = splits.assemble(splits.batches(tens, "sample_id", 16), "embedding", "shape")
    return out.select(
        "batch_index", F.get("batch_shape", F.lit(0)).alias("rows"), F.get("batch_shape", F.lit(2)).alias("height"),
        *digest(F.col("batch_values")),
    )


@reg.add(
    "every_nth_sample",
    f"""WITH {IDS} SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS rn, count(*) OVER () AS n FROM ids)
    WHERE rn % ceil(n / 37.0)::BIGINT = 0""",
)
def every_nth_sample(spark, d):
    return splits.every_nth(ids(spark, d).select("sample_id"), 37, [F.col("sample_id")])


@reg.add("first_n_samples", f"WITH {IDS} SELECT sample_id FROM ids ORDER BY sample_id DESC LIMIT 25")
def first_n_samples(spark, d):
    return splits.first_n(ids(spark, d).select("sample_id"), 25, [F.col("sample_id").desc()])
