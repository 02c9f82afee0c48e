"""The rows that the quality network learns from: never none, one for each id, of bounded length."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import quality_cnn


def test_large_classes_are_drawn_from(spark):
    labels = spark.range(3_600_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = labels.select("doc_id", F.when(F.col("quality") == 1, "good text").otherwise("@@ ## @@").alias("text"))
    model = quality_cnn.fit(docs, labels, per_class=1)
    assert model.prior is None


def test_one_bounded_row_for_each_id(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(quality_cnn, "train", lambda rows, **more: got.update(rows=rows, **more))
    ids = [i for i in range(40) if not spark.range(1).select(quality_cnn.held_out(F.lit(i))).first()[0]][:6]
    long_text = nasty.prose(60_000, 3)
    texts = [(ids[0], f"text {k} " + nasty.prose(50, k)) for k in range(300)] + [(ids[1], long_text)] + [(i, "short") for i in ids[2:]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], nasty.SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    quality_cnn.fit(docs, labels)
    sizes = [len(t) for t, _ in got["rows"]]
    assert len(sizes) == len(ids) and max(sizes) == 1 << 15 and got["cut"] == {1}
    part, raw = got["rows"][1][0], long_text.encode()
    starts = [raw.find(part[s : s + quality_cnn.CHUNK]) for s in range(0, len(part), quality_cnn.CHUNK)]
    assert min(starts) >= 0 and min(starts) < len(raw) / 10 and max(starts) > 0.9 * len(raw)
