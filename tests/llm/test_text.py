"""Words, shingles, filters and components beside plain loops."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from gridpanel.llm import bloom, text
from gridpanel.llm.components import components


@pytest.mark.parametrize("table, pattern", [(text.SPACED, brute.WORD), (text.ALNUM, brute.ALNUM)])
def test_words_equal_the_pattern(table, pattern, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 64)
    text.powers.cache_clear()
    rng = random.Random(1)
    values = ["".join(rng.choice("ab AZ\t\n09é.,ß\x00 ") for _ in range(rng.randrange(90))) for _ in range(300)]
    values += [None, "", "x" * 500, " "]
    column = pa.array(["skipped", *values]).slice(1)
    data, offsets = text.column_bytes(column)
    found = text.words(data, offsets, table)
    known = {}
    for i, value in enumerate(values):
        expected = brute.words(value, pattern)
        at = found.of(i)
        spelled = [brute.lower(bytes(data[s:e]).decode()) for s, e in zip(found.start[at], found.end[at])]
        assert spelled == expected
        for word, key in zip(expected, found.hash[at].tolist()):
            assert known.setdefault(word, key) == key
    assert len(set(known.values())) == len(known)
    text.powers.cache_clear()


def test_shingles_tell_order_and_length_apart():
    hashes = text.mix(np.arange(1, 11, dtype=np.uint64))
    assert len(text.shingle_set(hashes, 5)) == 6
    assert len(text.shingle_set(hashes[:3], 5)) == 1
    assert len(text.shingle_set(hashes[:0], 5)) == 0
    assert text.shingles(hashes[:5], 5)[0] != text.shingles(hashes[:5][::-1], 5)[0]
    assert text.shingles(hashes[:4], 4)[0] != text.shingles(hashes[:5], 5)[0]


def test_shingles_of_rearranged_words_differ():
    """No two arrangements of a few words hash alike, as they do if places weigh in simple proportions."""
    from itertools import product

    words = text.mix(np.arange(7, 10, dtype=np.uint64))
    rows = np.array(list(product(range(3), repeat=5)))
    keys = [text.shingles(words[row], 5)[0] for row in rows]
    assert len(set(keys)) == len(rows)


def test_bloom_filter_holds_all_members(spark):
    members = text.mix(np.arange(2000, dtype=np.uint64))
    rows = spark.createDataFrame([(int(x),) for x in members.view(np.int64)] + [(None,)], "h bigint")
    made = bloom.build(rows, "h", 16)
    assert made.holds(members).all()
    assert made.holds(text.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))).mean() < 0.02
    assert not bloom.build(rows.limit(0), "h", 8).holds(members).any()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    half = components(spark.createDataFrame(edges[::2], "a bigint, b bigint"))
    got = components(spark.createDataFrame(edges[1::2], "a bigint, b bigint"), half)
    assert {r.node: r.comp for r in got.collect()} == {x: find(x) for x in list(parent)}
