"""Line dedup with DataFrame functions only: lines that many documents hold are dropped everywhere.

Lines are exploded, normalised (blanks stripped at both ends, A-Z lower-cased) and hashed to 128 bits. Each document counts
once for each of its keys; the counts are combined on the map side, so a line in a third of the documents is one row of
each task. Lines with a frequent key give their positions back to their document, whose text is put together again from the
runs of lines between them.

Rows are written once with a number of their own, so equal rows and equal ``doc_id`` never meet in one task. The frequent keys
are broadcast only while there are at most ``BROADCAST_KEYS`` (16 bytes each); above that the lines are joined with them, and
keys that hold more than a thousandth of the lines, of which there are fewer than a thousand, are looked up apart.

Defined cases: a document is a row, so repeated rows (and rows with one ``doc_id``, or none) count one by one; a null or empty
text is one empty line; keys below ``min_chars`` code points are never dropped; a document whose lines all go keeps the empty
text; an empty table gives an empty table. Every input column stays, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import HOT_PARTS, text_or_empty, write_table

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Frequent keys that may be broadcast: 16 bytes each, 16 MB in all.
BROADCAST_KEYS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_keys(texts: DataFrame, *, min_documents: int, min_chars: int) -> DataFrame:
    """``h1``, ``h2`` and ``n`` (documents) of the keys that at least ``min_documents`` rows of ``text`` hold."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    lines = texts.select(F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    counted = lines.select(*_hashes("key")).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_documents)


def _positions(rows: DataFrame, frequent: DataFrame, min_chars: int, broadcast_keys: int) -> DataFrame:
    """``row`` and the sorted positions of its lines that have a frequent key."""
    lines = rows.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("row", "at", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars).select("row", "at", *_hashes("key"))
    size = frequent.agg(F.count(F.lit(1)), F.sum("n")).first()
    keys = frequent.select(*_KEY)
    if size[0] <= broadcast_keys:
        found = lines.join(F.broadcast(keys), _KEY, "left_semi")
    else:
        hot = F.broadcast(frequent.where(F.col("n") > F.lit(size[1] // HOT_PARTS)).select(*_KEY))
        rest = lines.join(hot, _KEY, "left_anti").join(keys.join(hot, _KEY, "left_anti"), _KEY, "left_semi")
        found = lines.join(hot, _KEY, "left_semi").unionByName(rest)
    return found.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("drop_at"))


def _kept_text(text: Column, drop_at: Column) -> Column:
    """The lines between the dropped positions, joined again; each line is copied once."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop_at, lambda p: p + 1))
    ends = F.concat(drop_at, F.array(F.size("lines")))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    kept = F.flatten(F.transform(runs, lambda r: F.slice(F.col("lines"), r["s"] + 1, r["e"] - r["s"])))
    return F.when(drop_at.isNull(), text).otherwise(F.array_join(kept, "\n"))


def drop_frequent_lines(
    docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """A row for each row of ``docs``: ``input`` (its columns but ``text``), the ``text`` left, ``n_lines`` before and ``n_dropped``."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")])
    rows, _ = write_table(docs.select(F.monotonically_increasing_id().alias("row"), others.alias("input"), text_or_empty().alias("text")))
    frequent, _ = write_table(frequent_keys(rows, min_documents=min_documents, min_chars=min_chars))
    joined = rows.join(_positions(rows, frequent, min_chars, broadcast_keys), "row", "left")
    out = joined.withColumn("lines", F.when(F.col("drop_at").isNotNull(), F.split("text", "\n")))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return out.select(
        "input", _kept_text(F.col("text"), F.col("drop_at")).alias("text"), n_lines.cast("long").alias("n_lines"),
        F.when(F.col("drop_at").isNull(), F.lit(0)).otherwise(F.size("drop_at")).cast("long").alias("n_dropped"),
    )


def cut_lines(docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of ``docs`` with the frequent lines taken out of ``text``."""
    out = drop_frequent_lines(docs, min_documents=min_documents, min_chars=min_chars)
    return out.select(*[F.col("text") if c == "text" else F.col("input")[c].alias(c) for c in docs.columns])
