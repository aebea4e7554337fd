"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

Each dimension becomes an ordered 63-bit coordinate: 32 bits of value (numbers scaled between their extremes, other
values by hash, so that equal ones stay together) above 31 bits of a hash of the text and the row, which settles ties
and keeps equal texts adjacent. The median of every node of a level is found in the same few jobs: sums of bytes by
the next 12 bits of the coordinate, narrowed until the cell that holds the median is small. Only one row for each
node ever reaches the driver. Leaves are as many as the target bytes ask for, and their bytes are near equal.

Places within a shard come from one range sort and counts by (shard, partition), so no task has to hold a shard.

Equal texts with equal metadata are neighbours and part only where a cut falls among them: a group of copies may
outweigh a shard, so groups are not kept whole against the law of near equal bytes.

Defined results: a null text counts one byte and has checksum 0; null metadata have coordinate 0; repeated rows are
all placed; a single row that outweighs a shard leaves some shards empty; an empty table gives an empty result; only
the id, text and dimension columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh_path, staged

BITS, STEP = 63, 12
#: A median is exact enough once its cell has this share of the node's bytes.
TOLERANCE = 0.0005
#: Levels between cuts of the lineage.
LEVELS_PER_STAGE = 4


def _coordinates(df: DataFrame, dimensions: list[str]) -> list[Column]:
    """One 63-bit coordinate for each dimension."""
    numeric = [c for c in dimensions if isinstance(df.schema[c].dataType, T.NumericType)]
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in numeric for f, n in ((F.min, "lo"), (F.max, "hi"))]).first() if numeric else None
    out = []
    for c in dimensions:
        if c in numeric:
            lo, hi = ends[f"{c}_lo"] or 0.0, ends[f"{c}_hi"] or 0.0
            value = ((F.col(c).cast("double") - lo) * (((1 << 32) - 1) / (hi - lo) if hi > lo else 0.0)).cast("long")
        else:
            value = F.crc32(F.col(c).cast("string").cast("binary"))
        out.append(F.shiftleft(F.coalesce(value, F.lit(0).cast("long")), 31).bitwiseOR(F.col("_tie")))
    return out


def _medians(rows: DataFrame, nodes: list[dict]) -> dict[int, int]:
    """For each node the largest coordinate of its left side; rows have node, _key (of the node's dimension) and size."""
    spark = rows.sparkSession
    state = {n["node"]: {"prefix": 0, "below": 0, "goal": n["bytes"] * n["left"] / n["shards"], "bytes": n["bytes"]} for n in nodes}
    shift = BITS
    while shift > 0:
        low = max(0, shift - STEP)
        now = spark.createDataFrame([(k, s["prefix"], float(s["goal"] - s["below"])) for k, s in state.items()], "node int, prefix long, rest double")
        # One row a node: bounded by the number of shards.
        part = rows.join(F.broadcast(now), "node").where(F.shiftright("_key", shift) == F.col("prefix"))
        part = part.groupBy("node", "rest", F.shiftright("_key", low).alias("cell")).agg(F.sum("size").alias("bytes"))
        order = Window.partitionBy("node").orderBy("cell")
        part = part.withColumn("end", F.sum("bytes").over(order)).where(F.col("end") >= F.col("rest"))
        found = part.groupBy("node").agg(F.min_by(F.struct("cell", "bytes", "end"), "cell").alias("c")).select("node", "c.*").collect()
        for r in found:
            s = state[r["node"]]
            s["prefix"], s["below"], s["cell_bytes"] = r["cell"], s["below"] + r["end"] - r["bytes"], r["bytes"]
        shift = low
        if all(s["cell_bytes"] <= TOLERANCE * s["bytes"] for s in state.values()):
            break
    # The whole cell goes to the side that brings the cut nearer to its goal.
    return {k: ((s["prefix"] + (s["below"] + s["cell_bytes"] / 2 <= s["goal"])) << shift) - 1 for k, s in state.items()}


def kd_shards(docs: DataFrame, dimensions: list[str], *, shards: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    meta = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.shiftleft(F.xxhash64(raw).bitwiseAND(F.lit(0xFFFF).cast("long")), 15).bitwiseOR(F.xxhash64(F.col(id_column)).bitwiseAND(F.lit(0x7FFF).cast("long"))).alias("_tie"),
        *[F.col(c).alias(f"_d{i}") for i, c in enumerate(dimensions)],
    )
    meta = staged(meta, "kd-rows")
    total = meta.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / (target_bytes or 256 << 20)))
    keys = _coordinates(meta, [f"_d{i}" for i in range(len(dimensions))])
    # A literal root would turn the joins on it into nested loops; sizes are at least 1.
    root = F.least("size", F.lit(0)).cast("int")
    rows = meta.select("doc_id", "size", "text_crc32", root.alias("node"), F.array(*keys).alias("_keys"))
    count, level = {0: shards}, 0
    while total and any(n > 1 for n in count.values()):
        spans = [(F.max(F.col("_keys")[i]) - F.min(F.col("_keys")[i])).alias(f"s{i}") for i in range(len(dimensions))]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *spans).collect()}
        nodes = [
            {"node": k, "shards": n, "left": n // 2, "bytes": stats[k]["bytes"], "dim": max(range(len(dimensions)), key=lambda i: (stats[k][f"s{i}"] >> 31, -i))} for k, n in count.items() if n > 1 and k in stats
        ]
        if not nodes:
            break
        # One row a node again.
        chosen = rows.sparkSession.createDataFrame([(n["node"], n["dim"]) for n in nodes], "node int, dim int")
        cut = _medians(rows.join(F.broadcast(chosen), "node").select("node", "size", F.get("_keys", F.col("dim")).alias("_key")), nodes)
        splits = rows.sparkSession.createDataFrame([(n["node"], n["dim"], cut[n["node"]], n["left"]) for n in nodes], "node int, dim int, cut long, left int")
        rows = rows.join(F.broadcast(splits), "node", "left").select(
            "doc_id", "size", "text_crc32", (F.col("node") + F.when(F.get("_keys", F.col("dim")) > F.col("cut"), F.col("left")).otherwise(0)).cast("int").alias("node"), "_keys"
        )
        count = reduce(lambda a, n: a | {n["node"]: n["left"], n["node"] + n["left"]: n["shards"] - n["left"]}, nodes, count)
        level += 1
        if level % LEVELS_PER_STAGE == 0:
            rows = staged(rows, "kd-level")
    return _with_slots(rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard")))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0 by id, without a gap."""
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows, "kd-order")
    run = F.shiftright("_at", 33).alias("_run")
    runs = rows.groupBy("shard", run).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = runs.select("shard", "_run", "_first", before.alias("_before"))
    # At most one row for each partition and shard.
    return rows.withColumn("_run", run).join(F.broadcast(runs), ["shard", "_run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first") + F.col("_before")).alias("slot"))


def write_sharded(docs: DataFrame, placed: DataFrame, out: str | None = None, *, id_column: str = "doc_id", text: str = "text") -> str:
    """Writes every row of ``docs`` once with its shard and slot, one folder a shard; ids may be null or repeated.

    Rows of one id, size and checksum are dealt to their places in any order.
    """
    out = out or fresh_path(docs.sparkSession, "shards")
    raw = F.coalesce(F.col(text), F.lit(""))
    mine = docs.withColumns({"_id": F.col(id_column), "_size": (F.octet_length(raw) + 1).cast("long"), "_crc": F.crc32(raw.cast("binary"))})
    mine = mine.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy("_id")))
    theirs = placed.select(F.col("doc_id").alias("_pid"), F.col("size").alias("_psize"), F.col("text_crc32").alias("_pcrc"), F.col("shard").alias("_pshard"), F.col("slot").alias("_pslot"))
    theirs = theirs.withColumn("_pn", F.row_number().over(Window.partitionBy("_pid", "_psize", "_pcrc").orderBy("_pshard", "_pslot")))
    same = F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_size") == F.col("_psize")) & (F.col("_crc") == F.col("_pcrc")) & (F.col("_n") == F.col("_pn"))
    rows = mine.join(theirs, same).select(*[mine[c] for c in docs.columns if c not in ("shard", "slot")], F.col("_pshard").alias("shard"), F.col("_pslot").alias("slot"))
    rows.repartition("shard").write.partitionBy("shard").parquet(out)
    return out
