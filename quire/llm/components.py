"""Connected components of a link table by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, sized, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node in ``edges`` (a, b), as a staged table.

    A round hooks every node to its smallest neighbour and that one's, then replaces the nodes of all edges by what they
    are hooked to and drops the edges that became loops or equal. Edges hence shrink from round to round, and in the end
    the hooks are followed back. Nodes should be hashes: then no long chain of ascending nodes is to be expected. Each
    round is written to the shared folder, which cuts the lineage.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = staged(ordered.distinct(), "cc-edges")
    n, hooks = left.count(), []
    while True:
        # The tables of a round are as many files as their rows need, not as a shuffle has partitions.
        parts = sized(n)
        # ``a`` is the smaller end, so a node's smallest neighbour below it is the least ``a`` of its edges as ``b``.
        low = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        own = left.select(F.col("a").alias("node")).distinct().join(low, "node", "left_anti").select("node", F.col("node").alias("up"))
        hook = staged(low.unionByName(own).coalesce(parts), "cc-hooks")
        next_up = hook.select(F.col("node").alias("_at"), F.col("up").alias("_top"))
        jumped = staged(hook.join(next_up, hook["up"] == next_up["_at"]).select("node", F.col("_top").alias("up")).coalesce(parts), "cc-hooks")
        forget(hook)
        hooks.append(jumped)
        if not n:
            break
        above = lambda end: jumped.select(F.col("node").alias(end), F.col("up").alias("up_" + end))  # noqa: B023, E731
        moved = left.join(above("a"), "a").join(above("b"), "b").where("up_a <> up_b")
        new = staged(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct().coalesce(parts), "cc-edges")
        forget(left)
        left, n = new, new.count()
        if not n:
            break
    forget(left)
    used = [hooks.pop()]
    labels = used[0].withColumnRenamed("up", "label")
    while hooks:
        hook = hooks.pop()
        top = labels.select(F.col("node").alias("_at"), "label")
        labels = hook.join(top, hook["up"] == top["_at"], "left").select("node", F.coalesce("label", "up").alias("label"))
        used.append(hook)
    if len(used) == 1:
        return labels
    out = staged(labels, "cc-labels")
    forget(*used)
    return out
