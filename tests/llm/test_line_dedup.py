"""Line dedup against a plain count of lines, with few and with very frequent keys."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import common, line_dedup
from framewise.operators import joins

BLANKS = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(texts, least, min_chars=1):
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


TEXTS = [
    "Menu\n  HOME \nreal text", "menu\t\nreal text two\nhome", "MENU", "menu\nmenu\nMenu", None, "", "\n\n", " \n\x0b\n", "Über\nüber\nÜBER", "ÜbEr",
    "K\nk\nKKk", "x\r\ny\x0b\nz", "home\nmenu\nlast", "a\nmenu\nb\n\nhome\n", "\x1chome", "real text\nx",
]


@pytest.mark.parametrize("least, min_chars, broadcast_keys", [(2, 1, 100), (2, 1, 0), (4, 1, 100), (3, 4, 0), (100, 1, 100)])
def test_plain_count(spark, least, min_chars, broadcast_keys):
    texts = TEXTS * 2 + ["hot line\n" + str(i) for i in range(300)]
    docs = nasty.plain(spark, texts).repartition(5)
    out = line_dedup.drop_frequent_lines(docs, min_documents=least, min_chars=min_chars, broadcast_keys=broadcast_keys).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in out) == brute(texts, least, min_chars)


def test_awkward_table(spark):
    docs = nasty.table(spark)
    out = line_dedup.cut_lines(docs, min_documents=2)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in nasty.rows())
    assert all(r[c] == f"extra {c}" for r in rows for c in nasty.CLASHES)
    assert sorted(r.text for r in rows) == [t for t, _, _ in brute([r[1] for r in nasty.rows()], 2)]
    assert line_dedup.cut_lines(nasty.table(spark, []), min_documents=2).collect() == []


def test_long_text_and_repeated_rows(spark):
    long_text = "\n".join(f"line {i % 60_000}" for i in range(120_000))
    texts = [long_text, "line 7\nnew", "line 7"] + ["same row\nline 7"] * 5
    docs = spark.createDataFrame([(1, t, "en", "s", 0) for t in texts], nasty.SCHEMA)
    out = line_dedup.drop_frequent_lines(docs, min_documents=5).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in out) == brute(texts, 5)


def test_no_python_in_the_plan(spark):
    plan = line_dedup.drop_frequent_lines(nasty.plain(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_look_up_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    monkeypatch.setattr(joins, "HOT_PARTS", 4)
    big = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(400)] + [(None, -1)], "k long, v long")
    small = spark.createDataFrame([(i, f"s{i}") for i in range(0, 300)] + [(None, "none")], "k long, s string")
    joined = common.look_up(big, small, ["k"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == sorted(tuple(r) for r in big.join(small, "k").collect())
