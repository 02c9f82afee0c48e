"""Tables with every awkward case, shared by the tests."""

import random

from pyspark.sql import types as T

#: Names that the operators use inside; as extra columns they must do no harm.
CLASHES = ("row", "text_hash", "fp", "k", "rng", "doc", "kept", "shard", "node", "root", "h", "words", "score", "spans")


def prose(n_words: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(max(20, n_words // 3))]
    out = []
    for i in range(n_words):
        out.append(r.choice(words) + (".\n" if i % 17 == 16 else "," if i % 7 == 6 else ""))
    return " ".join(out) + "."


def rows() -> list[tuple]:
    long_text = prose(30_000, 1)
    base = prose(300, 2)
    near = base.replace("s", "z", 1)
    passage = prose(80, 3)
    texts = [
        (None, None), (None, base), (1, ""), (2, None), (3, "a"), (3, "a"), (4, long_text), (5, base), (6, base), (7, near), (8, near), (8, near),
        (9, prose(40, 4) + " " + passage + " " + prose(40, 5)), (10, prose(60, 6) + "\n" + passage + "\n" + prose(30, 7)), (11, passage),
        (12, " \n\t "), (13, "Ünï © 漢字 🙂 <|endoftext|> <|startoftext|>  x   y \n z"), (-5, prose(120, 8)), (14, "same " * 400), (15, "a b"),
        (8, prose(90, 9)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark, data=None, partitions: int = 3):
    """The awkward table with clashing extra columns, in a few partitions."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if data is None or data:
        df = df.repartition(partitions)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


def plain(spark, texts: list[str | None], first_id: int = 0):
    return spark.createDataFrame([(first_id + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
