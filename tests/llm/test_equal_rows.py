"""Shards of a table in which one whole row is repeated for a third of it."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import sharding


@pytest.mark.parametrize("row", [(7, "copy " * 20), (None, None)])
@pytest.mark.parametrize("with_text", [False, True])
def test_equal_rows_are_parted(spark, row, with_text):
    n = 4000
    rows = [(*row, "en", "s", 0)] * n + [(i, f"{i} " * 10 if row[1] else str(i), "en", "s", 0) for i in range(100, 100 + 2 * n)]
    df = spark.createDataFrame(rows, nasty.SCHEMA).repartition(4)
    out = sharding.shard(df, 8, ranges=64, with_text=with_text).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    own = [[r for r in out if r.shard == s] for s in range(8)]
    sizes = [sum(r.size for r in shard) for shard in own]
    assert max(sizes) < 1.15 * sum(sizes) / 8
    assert all(sorted(r.slot for r in shard) == list(range(len(shard))) for shard in own)
    if with_text:
        texts = {r[0]: r[1] or "" for r in rows}
        assert all(r.text == texts[r.doc_id] for r in out)
