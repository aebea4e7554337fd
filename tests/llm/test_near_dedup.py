"""Near duplicates: counting of common shingles, blocks, and units that are compared by bucket, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm import minmax_dedup


def texts(n: int, seed: int) -> list[str]:
    """Groups of changed copies on both sides of the similarity bound, and texts that share a passage."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    out = []
    while len(out) < n:
        base = [f"w{r.randrange(4000)}" for _ in range(40)]
        for _ in range(r.choice([1, 2, 12])):
            words = list(base)
            for _ in range(r.randrange(5)):
                words[r.randrange(40)] = f"c{r.randrange(4000)}"
            out.append(" ".join(words + (passage if r.random() < 0.3 else [])))
    return out[:n]


def components(rows: list[str], length: int) -> list[int]:
    sets = [frozenset(tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))) for w in (t.split() for t in rows)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    return label


def test_common_shingles_are_counted_exactly():
    r = np.random.default_rng(5)
    for size, values in ((1, 5), (2, 30), (60, 90), (60, 3000), (200, 400)):
        sets = [np.unique(r.integers(0, values, r.integers(1, 80)).astype(np.uint64)) for _ in range(size)]
        plain = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (minmax_dedup.common_shingles(sets) == plain).all()
        half = size // 2
        if half:
            assert (minmax_dedup.common_shingles(sets[:half], sets[half:]) == plain[:half, half:]).all()


@pytest.mark.parametrize(("block", "chained"), [(1024, 100_000), (5, 100_000), (4, 3)])
def test_components_do_not_depend_on_blocks(spark, monkeypatch, block, chained):
    monkeypatch.setattr(minmax_dedup, "BLOCK_TEXTS", block)
    monkeypatch.setattr(minmax_dedup, "CHAINED", chained)
    rows = texts(180, 3)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(df, length=2).collect()}
    want = components(rows, 2)
    assert len(set(want)) < len(rows) - 40 and [got[i] for i in range(len(rows))] == want


def test_deduplicated_keeps_one_row_of_repeated_rows(spark):
    a, b = texts(2, 9)
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (None, b, "x"), (None, b, "x"), (5, None, "n"), (5, None, "n"), (6, "", "n"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string")
    kept = sorted(map(repr, map(tuple, minmax_dedup.deduplicated(df.withColumnRenamed("_own", "kept")).collect())))
    assert kept == sorted(map(repr, [(1, a, "x"), (None, b, "x"), (5, None, "n"), (6, "", "n"), (None, None, None)]))
    assert minmax_dedup.deduplicated(df.limit(0)).count() == 0


def test_a_very_long_text_is_compared_whole(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    other = words[:50_000] + [f"z{i}" for i in range(10_000)]
    tail = words[:59_000] + [f"z{i}" for i in range(1000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(tail))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(df, length=2).collect()} == {1: 1, 2: 2, 3: 1}
