"""Chunk fingerprints of texts that are as short as a chunk."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import cdc


@pytest.mark.parametrize("low, high", [(20, 50), (50, 100), (100, 200), (200, 400), (400, 600)])
def test_three_unchanged_quarters_show(low, high):
    r = random.Random(low)
    half, above = 0, 0
    for k in range(100):
        text, other = (nasty.prose(200, 2 * k + j + 10_000)[: r.randrange(low, high)] for j in (0, 1))
        own, new, far = (cdc.chunk_digests(t.encode()) for t in (text, cdc.edited(text, other), other))
        near = cdc.containment(own, new)
        half += near >= 0.5
        above += near > cdc.containment(own, far)
        assert cdc.decode(cdc.encode(own)) == own
    assert half >= (85 if low < 50 else 95) and above >= 99
