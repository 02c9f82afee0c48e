"""What the driver draws and what workers remember stays bounded, whatever the table holds."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise import session
from framewise.llm import bpe_dp, bpe_ids, common, suffix_dedup, token_counts
from framewise.llm.queries import vocabulary


def test_sample_of_a_table_of_copies(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(token_counts, "LengthTable", lambda lengths: seen.append(lengths) or lengths)
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("word"), F.col("id") % 7)).alias("text"))
    token_counts.frequent_lengths(rows, bpe_ids.read_vocabulary(vocabulary("byte_bpe_50k.json")))
    assert set(seen[0]) >= {b"hot", b" text", b"word"}


def test_sample_has_a_bound_and_is_never_empty(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(token_counts, "SAMPLE_DOCUMENTS", 20)
    monkeypatch.setattr(token_counts, "LengthTable", lambda lengths: drawn.append(lengths) or lengths)
    docs = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("text"))
    token_counts.frequent_lengths(docs.limit(50_000), bpe_ids.read_vocabulary(vocabulary("byte_bpe_50k.json")))
    assert 20 <= len(drawn[0]) <= 60


def test_long_words_are_not_remembered():
    bpe = bpe_dp.PrefixBpe(bpe_ids.read_vocabulary(vocabulary("word_bpe_49k.json")))
    ids = bpe_ids.PieceEncoder(bpe_ids.read_vocabulary(vocabulary("byte_bpe_50k.json")))
    text = "short " + "y" * 5000 + " " + "z" * 70
    assert bpe.encode(text) == bpe.encode(text) and ids.encode(text) == ids.encode(text)
    for memory in (bpe.words, bpe.pieces, ids.pieces):
        assert all(len(k) <= 64 for k in memory)


def test_vocabulary_without_a_byte_raises(monkeypatch):
    bpe = bpe_dp.PrefixBpe(bpe_ids.read_vocabulary(vocabulary("word_bpe_49k.json")))
    monkeypatch.setattr(bpe, "automaton", type("Nothing", (), {"iter": lambda self, s: iter(())})())
    with pytest.raises(ValueError, match="no token"):
        bpe.encode("word")


def test_written_tables_are_released(spark, tmp_path):
    with session.staging(spark):
        _, path = common.write_table(nasty.plain(spark, ["a", "b"]))
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.isdir(path.removeprefix("file:"))


def test_texts_are_cut_by_one_worker_of_a_task(spark):
    """A second pass over the texts takes a second Python worker of each task, which later stages fill as well."""
    passage = " ".join(f"word{i}" for i in range(60))
    docs = nasty.plain(spark, [f"a {passage} b", f"c {passage} d", passage, "no passage", "", None])
    cut = suffix_dedup.cut_repeats(docs)
    plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("without(") and sum("ArrowEvalPython [without(" in line for line in plan.split("\n")) == 1
    assert sorted(r.text or "" for r in cut.collect()) == ["", "", f"a {passage} b", "c d", "no passage"]
