"""Product codes against plain loops over integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from quire.llm import vector_codes

INF, NAN = float("inf"), float("nan")


def expected(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], sha) for (i, label, _), f, e in zip(kept, found, errors, strict=True)), key=repr)


def test_codes_equal_plain_loops(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 2]), [r.choice([0.0, 0.25, r.uniform(-1, 1)]) for _ in range(12)]) for i in range(90)]
    rows += [(200, 1, None), (-5, 1, []), (-4, 1, [1.0] * 11 + [NAN]), (-3, None, [1.0] * 11 + [None]), (-2, 2, [INF] + [0.0] * 11), (300, 2, rows[4][2]), (300, 2, rows[4][2])]
    for entries, rounds in ((8, 2), (64, 2), (200, 1), (1, 0)):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
        exact = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
        got = vector_codes.code_report(df, parts=4, entries=entries, rounds=rounds)
        assert sorted(map(tuple, got.collect()), key=repr) == expected(exact, 4, entries, rounds)


def test_odd_lengths_null_ids_and_names_in_the_way(spark):
    rows = [(None, None, [1.0, 2.0], 1), (1, None, [1.0, 2.5], 2), (2, 3, [1.0], 3), (3, 3, [1.0, 2.0, 3.0, 4.0], 4), (4, 3, [1e30, -1e30], 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, id int")
    got = {r["vec_id"]: r for r in vector_codes.code_report(df, parts=2, entries=2, rounds=1).collect()}
    assert set(got) == {None, 1, 4} and got[1]["label_error"] == got[None]["label_error"] == got[1]["error"] + got[None]["error"]
    assert vector_codes.code_report(df.limit(0)).collect() == []


def test_shuffled_label_sums_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3 or None, [i / 10, 1.0]) for i in range(30)], "vec_id long, label int, embedding array<float>")
    broadcast = sorted(map(tuple, vector_codes.code_report(df, parts=1, entries=4).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.code_report(df, parts=1, entries=4).collect())) == broadcast


def test_partial_search_is_exact_on_ties():
    r = np.random.default_rng(1)
    parts, book = r.integers(-3, 4, (5000, 3)), r.integers(-3, 4, (40, 3))
    full = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    entry, far = vector_codes.nearest(parts, book)
    assert (entry == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_codes_stand_for_near_vectors(spark):
    df = spark.createDataFrame([(i, 0, [math.sin(i), math.cos(i)]) for i in range(300)], "vec_id long, label int, embedding array<double>")
    rows = vector_codes.quantised(df, parts=2)
    books = vector_codes.fit_codebooks(rows, parts=2, entries=64)
    back = {r["id"]: r["vector"] for r in vector_codes.decoded(vector_codes.encode(rows, books), books).collect()}
    assert max(abs(back[i][0] - math.sin(i)) for i in range(300)) < 0.1
