"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import bpe_dp, cdc, line_rules, packing, quality_cnn, sharding, simhash, suffix_dedup, token_counts, url_classes
from framewise.llm.queries import vocabulary


def labels(spark, ids=(4, 5, 9, 14, 13)):
    return spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "edited_pairs": lambda s, d: cdc.edited_pairs(d),
    "small_ranges": lambda s, d: cdc.edited_pairs(d, range_bytes=2000, with_text=True),
    "bpe": lambda s, d: bpe_dp.encode(d, vocabulary("word_bpe_49k.json"), decoded=True),
    "cnn": lambda s, d: quality_cnn.score(d, quality_cnn.fit(d, labels(s), per_class=3)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "line_rules": lambda s, d: line_rules.judge(d),
    "sharding": lambda s, d: sharding.shard(d, 3, ranges=8, parts=2),
    "counts": lambda s, d: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")),
}
KEEPING = {
    "keep_good": lambda s, d: quality_cnn.keep_good(d, quality_cnn.fit(d, labels(s), per_class=3)),
    "clean": lambda s, d: line_rules.clean(d),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "cut_repeats": lambda s, d: suffix_dedup.cut_repeats(d),
}


@pytest.fixture(scope="module")
def awkward(spark):
    return nasty.table(spark).cache()


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_for_each_row(spark, awkward, name):
    out = PER_ROW[name](spark, awkward).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in nasty.rows())


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay(spark, awkward, name):
    out = KEEPING[name](spark, awkward)
    assert out.columns == awkward.columns
    for r in out.collect():
        assert all(r[c] == f"extra {c}" for c in nasty.CLASHES)


@pytest.mark.parametrize("name", [*PER_ROW, *KEEPING, "passages", "pack"])
def test_empty_table(spark, name):
    more = {"passages": lambda s, d: suffix_dedup.passages(d), "pack": lambda s, d: packing.pack(d, vocabulary("byte_bpe_50k.json"))}
    empty = nasty.table(spark, [])
    assert (PER_ROW | KEEPING | more)[name](spark, empty).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (2, "no scheme", None), (2, "no scheme", None)], "page_id long, url string, html string")
    out = url_classes.judge(pages).collect()
    assert len(out) == 4 and all(r.verdict == "allow" and r.rule is None and r.host == "" and r.path == "" for r in out)
    assert url_classes.judge(pages.where("false")).collect() == []


def test_pack_awkward(spark, awkward):
    out = packing.pack(awkward, vocabulary("byte_bpe_50k.json")).collect()
    assert sum(r.start == 0 for r in out) == len(nasty.rows())
