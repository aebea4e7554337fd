"""Connected components against union-find."""

from __future__ import annotations

import random

from quire.llm.components import connected_components


def plain(edges):
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((label[a], label[b]))
        if lo != hi:
            label = {k: lo if v == hi else v for k, v in label.items()}
    return label


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    return {r["node"]: r["label"] for r in connected_components(df).select("node", "label").collect()}


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(7)
    graphs = [[(r.randrange(n), r.randrange(n)) for _ in range(m)] for n, m in ((4, 3), (60, 40), (300, 260))]
    names = r.sample(range(10**6), 200)
    graphs.append(list(zip(names, names[1:])))
    graphs.append([(names[0], x) for x in names[1:]] + [(5, 5), (names[1], names[0])])
    graphs.append([(i, i + 1) for i in range(40)])
    for edges in graphs:
        assert found(spark, edges) == plain([e for e in edges if e[0] != e[1]])
    assert found(spark, [(1, 1)]) == {}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
