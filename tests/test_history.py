"""As-of joins, states at a time, sketches and vector search against plain versions."""

from __future__ import annotations

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import history, similar, sketches
from quire.operators.similar import VectorIndex

DAY = dt.datetime(2020, 1, 1)


def test_as_of_equals_a_loop_also_for_a_key_in_many_ranges(spark):
    r = random.Random(6)
    when = lambda: r.choice([None, *[DAY + dt.timedelta(hours=r.randrange(500))] * 9])
    rows = [(i, r.choice(["a", "b", "hot", "hot", "hot", None]), when()) for i in range(900)]
    changes = [(r.choice(["a", "hot", "hot", "c", None]), when(), r.choice([None, 1, 2, 3]), "x") for _ in range(300)]
    df = spark.createDataFrame(rows, "i int, key string, at timestamp").repartition(5)
    got = {x["i"]: x["v"] for x in history.as_of(df, spark.createDataFrame(changes, "key string, at timestamp, v int, w string").repartition(3)).collect()}
    for i, key, at in rows:
        known = [(t, v is not None, v or 0) for k, t, v, _ in changes if k == key and None not in (k, t, at) and t <= at]
        assert got[i] == (max(known)[2] if known and max(known)[1] else None), (i, key, at)
    assert len(got) == len(rows) and history.as_of(df.limit(0), spark.createDataFrame([], "key string, at timestamp, v int")).count() == 0
    with pytest.raises(ValueError):
        history.as_of(df, df)


def test_state_at_a_time(spark):
    rows = [("k", "f", "1", DAY), ("k", "f", None, DAY + dt.timedelta(1)), ("k", "g", "2", DAY), ("k", "f", "3", DAY + dt.timedelta(9))]
    df = spark.createDataFrame(rows, "key string, field string, value string, at timestamp")
    assert sorted(map(tuple, history.state_at(df, "2020-01-05 00:00:00").collect())) == [("k", "f", None), ("k", "g", "2")]


def test_united_sketches_are_those_of_all_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("library"), (F.col("id") * 17 % 50_021).alias("key"), (F.col("id") * 31 % 200_000 / 1000).alias("cites"))
    parts = sketches.sketched(df, ["library"], distinct=("key",), quantiles=("cites",))
    whole = sketches.estimates(sketches.united(parts)).first()
    assert whole["rows"] == 200_000 and abs(whole["distinct_key"] - 50_021) <= 4 * sketches.DISTINCT_ERROR * 50_021
    assert all(abs(q / 200 - x) <= sketches.RANK_ERROR for q, x in zip(whole["quantiles_cites"], (0.25, 0.5, 0.75), strict=True))


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 0.3, (150, 8)) for c in r.normal(0, 1, (12, 8))] + [np.ones((200, 8))])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return points, spark.createDataFrame([*rows, (9000, None), (9001, [1.0]), (9002, [float("nan")] * 8), (None, rows[0][1])], "id long, vector array<double>").repartition(4)


def brute(points, q, k):
    far = np.round(np.sqrt(((points - points[q]) ** 2).sum(1)), similar.DECIMALS)
    return [(int(i), far[i]) for i in sorted(range(len(points)), key=lambda i: (far[i], i))[:k]]


def test_exact_search_is_a_full_scan_and_few_cells_find_most(spark, cloud, monkeypatch):
    points, df = cloud
    monkeypatch.setattr(similar, "ROW_BLOCK", 100)
    monkeypatch.setattr(similar, "QUERY_BLOCK", 7)
    index = VectorIndex.build(df, cells=30)
    asked = df.where("id % 50 = 0 and id < 9000").select(F.col("id").alias("query"), "vector")
    got = collections.defaultdict(list)
    for r in index.search(asked, 10, probes=2, exact=True).orderBy("query", "place").collect():
        got[r["query"]].append((r["id"], r["distance"]))
    want = {q: brute(points, q, 10) for q in range(0, len(points), 50)}
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}
    few = index.search(asked, 10, probes=5).groupBy("query").agg(F.collect_set("id").alias("ids")).collect()
    recall = sum(len(set(r["ids"]) & {i for i, _ in want[r["query"]]}) for r in few) / (10 * len(want))
    assert recall >= 0.9


def test_odd_tables_of_vectors(spark, cloud):
    _, df = cloud
    none = VectorIndex.build(df.limit(0))
    asked = spark.createDataFrame([(1, [0.0] * 8)], "query int, vector array<float>")
    assert none.search(asked).collect() == []
    few = VectorIndex.build(df.where("id < 3"))
    assert [r["place"] for r in few.search(asked, 10, exact=True).orderBy("place").collect()] == [1, 2, 3]
