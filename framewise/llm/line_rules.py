"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation, shouting, symbol and boilerplate rules; failed lines are removed, and
a document that fails the base counts or loses too much of its text is rejected.

Defined cases: a null text counts as empty (no words, so the base rule rejects it); blank lines are neither judged nor
counted; repeated rows are judged one by one; an empty table gives an empty table. ``judge`` carries only ``doc_id`` and
``text``; ``clean`` keeps every input column whatever its name, as the whole row travels in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import BLANKS, text_or_empty

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_LOST_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·"

#: Phrases that mark a line as boilerplate when the line has at most ``BOILERPLATE_MAX_CHARS`` characters.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign up", "skip to content",
    "terms of service", "terms of use",
)
BOILERPLATE_MAX_CHARS = 120


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes.

    * symbols: as many of ``#*$%&|<>`` as half the words, or more;
    * navigation: four or more separators ``|``, ``»``, ``›`` or ``·``, at least one for each eight words;
    * shouting: three or more runs of two exclamation marks;
    * punctuation: five or more words and no sentence mark anywhere;
    * boilerplate: a short line with one of the fixed phrases.
    """
    words = F.size(F.split(line, " "))
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    separators = F.length(F.regexp_replace(line, f"[^{SEPARATORS}]+", ""))
    crowded = line.rlike(f"[{SYMBOLS}{SEPARATORS}]") & ((symbols * 2 >= words) | ((separators >= 4) & (separators * 8 >= words)))
    shouting = line.contains("!!") & line.rlike(r"(?s)!!.*!!.*!!")
    unpunctuated = ~line.rlike("[.!?…。！？।؟:;]") & (words >= 5)
    boilerplate = (F.length(line) <= BOILERPLATE_MAX_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return crowded | shouting | unpunctuated | boilerplate


def _repeat_words(windows: Column) -> Column:
    """Words under at least one window whose hash is there twice; ``windows`` holds (hash, position) sorted."""
    n = F.size(windows)
    marked = F.transform(
        windows,
        lambda w, i: F.when(
            F.get(windows, i - 1)["h"].eqNullSafe(w["h"]) | F.get(windows, i + 1)["h"].eqNullSafe(w["h"]), w["i"]
        ),
    )
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    return F.when(n == 0, F.lit(0)).otherwise(
        F.aggregate(
            starts,
            F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last")),
            lambda a, s: F.struct(
                (a["covered"] + F.least(F.lit(WINDOW), s - a["last"])).alias("covered"), s.alias("last")
            ),
            lambda a: a["covered"],
        )
    )


def judge(docs: DataFrame, *, max_lost_share: float = MAX_LOST_SHARE) -> DataFrame:
    """Per row of ``docs``: the base counts, the cleaned text, the share of characters lost, and the verdict."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return _judged(base, max_lost_share)


def _with_windows(df: DataFrame) -> DataFrame:
    """``windows``: hashes of all runs of ``WINDOW`` = 5 words, joined from hashes of 1 + 1, 2 + 2 and 4 + 1 words.

    Each step is a column of its own, so that no step is evaluated twice.
    """

    def joined(left: str, right: str, shift: int) -> Column:
        return F.zip_with(left, F.slice(right, shift + 1, F.size(right)), lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("two", joined("one", "one", 1)).withColumn("four", joined("two", "two", 2))
    df = df.withColumn("five", joined("four", "one", 4))
    windows = F.slice("five", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    return df.withColumn("windows", windows).drop("one", "two", "four", "five")


def _judged(base: DataFrame, max_lost_share: float) -> DataFrame:
    text = F.col("text")
    df = base.withColumn("bare", F.btrim(text, F.lit(" \t\n\x0b\f\r"))).withColumn("lines", F.split(text, "\n"))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"[{BLANKS}]+"))
    df = _with_windows(df.withColumn("words", words)).withColumn("content", F.filter("lines", lambda x: x.rlike(f"[^{BLANKS}]")))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn(
        "sorted",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "n_repeat_words", F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(_repeat_words(F.col("sorted"))).cast("long")
    )
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("content") - F.size(F.array_distinct("content"))).cast("long"))
    good = F.filter("lines", lambda x: ~line_fails(x) | ~x.rlike(f"[^{BLANKS}]"))
    df = df.withColumn("clean_text", F.array_join(good, "\n"))
    lost = F.when(F.length(text) == 0, F.lit(0.0)).otherwise(1 - F.length("clean_text") / F.length(text))
    df = df.withColumn("lost_share", lost)
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost_share))
    # The optimiser would push a caller's filter on these columns below the steps above, and write each step out again
    # for each of its uses. It leaves rows alone that come out of an explode, here of one struct each.
    out = df.drop("bare", "words", "lines", "content", "windows", "sorted")
    return out.select(F.explode(F.array(F.struct("*"))).alias("one")).select("one.*")


def clean(docs: DataFrame, *, max_lost_share: float = MAX_LOST_SHARE) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; ``text`` is the cleaned text."""
    packed = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    kept = _judged(packed, max_lost_share).where("kept")
    return kept.select(*[F.col("clean_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
