"""Exact deduplication against a dictionary of texts, over several levels and in one."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from quire.llm import radix_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def expected(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and which id every group keeps once."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i))
        out.update((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    return out, len(groups)


def texts(r: random.Random) -> list[str | None]:
    base = "".join(r.choice("abcdé ") for _ in range(3000))
    near = [base[:i] + "#" + base[i + 1 :] for i in (0, 7, 31, 32, 33, 159, 160, 161, 700, 2998, 2999)]
    cut = [base[:i] for i in (0, 1, 31, 32, 33, 159, 160, 161, 672, 2999)]
    return [*near * 3, *cut * 2, *[base] * 40, *[base.upper()] * 5, None, "", "É", "é", "x" * 500_000, "x" * 500_000, "x" * 500_001, *(str(r.randint(0, 30)) for _ in range(60))]


@pytest.mark.parametrize("bounds", [{}, {"leaf_rows": 3}, {"leaf_rows": 1, "first_digit": 1}, {"leaf_bytes": 100, "first_digit": 4}])
def test_classes_equal_those_of_a_dictionary(spark, bounds):
    r = random.Random(5)
    found = texts(r)
    r.shuffle(found)
    rows = [(r.choice([None, i, i, i, 7]), t) for i, t in enumerate(found)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = radix_dedup.exact_duplicates(df, **bounds).collect()
    want, groups = expected(rows)
    assert collections.Counter((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got) == want
    kept = [x for x in got if x["kept"]]
    assert len(kept) == groups and all(x["doc_id"] == x["keep_id"] for x in kept)


def test_a_shuffle_join_of_open_parts_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(radix_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, "same text, longer than a digit of the first level" if i % 3 else f"other {i % 40}") for i in range(400)]
    got = radix_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf_rows=20).collect()
    assert collections.Counter((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got) == expected(rows)[0]


def test_whole_rows_stay_with_all_columns(spark):
    df = spark.createDataFrame([("b", "T", 1, 2), ("a", "t", 3, 4), (None, "t", 5, 6), ("a", "u", 7, 8)], "doc_id string, text string, row int, part int")
    assert sorted(map(tuple, radix_dedup.deduplicated(df).collect())) == [("a", "u", 7, 8), ("b", "T", 1, 2)]
    assert radix_dedup.exact_duplicates(df.limit(0)).collect() == [] and radix_dedup.deduplicated(df.limit(0)).columns == df.columns
