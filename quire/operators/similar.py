"""Entries with like vectors: an inverted-file index over distributed k-means, with exact distances and an exact mode.

Centres are fitted on a bounded sample of SAMPLE rows, chosen by a hash; every row is then put into the cell of its nearest
centre. A query looks into the cells of its nearest centres and measures every vector there. In exact mode it goes on: by
the triangle inequality a cell further from the query than its own radius plus the k-th best distance cannot hold a better
one, all other cells are measured too, and the result is that of a full scan.

Cells are cut into blocks of rows and their queries into blocks, and two blocks meet in one task, so a cell with a third of
all rows is many tasks; what leaves a task is the k best for each query. Rows without a vector of the common length are
left out; distances are Euclidean, ties go to the lower id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shipping import map_batches, ship_package
from quire.sources.storage import staged

SAMPLE, ROUNDS, PROBES, MOST_CELLS = 20_000, 6, 12, 4096
ROW_BLOCK, QUERY_BLOCK = 4096, 512
#: Share of the cells that an inexact search looks into: these vectors form few clusters (recall 0.905 at 23 of 45 cells, 0.963 at 30).
PROBE_SHARE = 0.6
#: Distances are compared to so many decimals, so that equal vectors tie whatever task measured them.
DECIMALS = 9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :], 0.0)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class VectorIndex:
    """Cells of ``rows`` (id, vector): ``cells`` is the stored table id, cell, block, vector; ``radii`` one row a cell."""

    def __init__(self, centres: np.ndarray, cells: DataFrame):
        self.centres, self.cells = centres, cells
        self.radii = {r["cell"]: r["radius"] for r in cells.groupBy("cell").agg(F.max("far").alias("radius")).collect()}  # at most MOST_CELLS

    @classmethod
    def build(cls, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits centres (by default as many as the root of the rows) and stores every row under its cell."""
        good = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))).select("id", F.col("vector").cast("array<double>").alias("vector"))
        usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
        if usual is None:
            return cls(np.zeros((0, 0)), good.select("id", F.lit(0).alias("cell"), F.lit(0).alias("block"), "vector", F.lit(0.0).alias("far")))
        good = staged(good.where(F.size("vector") == usual["n"]), "vectors")
        count = usual["count"]
        k = min(MOST_CELLS, cells or max(1, round(count**0.5)))
        share = min(1.0, 2.0 * sample / count)
        chosen = good.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else good
        chosen = staged(chosen.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector"), "vector-sample")
        centres = np.array([r["vector"] for r in chosen.limit(k).collect()])
        for _ in range(ROUNDS):
            centres = cls._moved(chosen, centres)
        return cls(centres, staged(cls._placed(good, centres), "vector-cells"))

    @staticmethod
    def _moved(chosen: DataFrame, centres: np.ndarray) -> np.ndarray:
        """The means of the cells; every task sends one row a cell."""

        def run(batches):
            import pyarrow as pa

            n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column(0))
                    at = _distances(m, centres).argmin(1)
                    np.add.at(n, at, 1)
                    np.add.at(total, at, m)
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.float64()))], ["cell", "n", "total"])

        new = centres.copy()
        width = centres.shape[1]
        sums = map_batches(chosen, run, "cell long, n long, total array<double>").groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
        for r in sums.collect():
            new[r["cell"]] = np.array(r["total"]) / r["n"]
        return new

    @staticmethod
    def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """id, cell, block, vector and the distance to the centre."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                far = _distances(_matrix(b.column(1)), centres) if b.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far.argmin(1).astype(np.int32)), pa.array(np.sqrt(far.min(1)) if len(far) else np.zeros(0))], ["id", "vector", "cell", "far"])

        kind = rows.schema["id"].dataType.simpleString()
        found = map_batches(rows, run, f"id {kind}, vector array<double>, cell int, far double")
        sizes = staged(found, "vector-found")
        blocks = sizes.groupBy("cell").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("_blocks"))
        # At most MOST_CELLS rows: broadcast.
        return sizes.join(F.broadcast(blocks), "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("block"), "vector", "far")

    def _looks(self, queries: DataFrame, probes: int, rest: bool = False) -> DataFrame:
        """query, qvector, cell: the ``probes`` nearest cells of each query (query, vector, bound), or of the others those that may hold a vector within its bound."""
        centres = self.centres
        radii = np.array([self.radii.get(c, -np.inf) for c in range(len(centres))])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                far = np.sqrt(_distances(_matrix(b.column(1)), centres)) if b.num_rows else np.zeros((0, len(centres)))
                order = np.argsort(far, axis=1, kind="stable")
                row, cell = np.repeat(np.arange(b.num_rows), len(centres)), order.ravel()
                place = np.tile(np.arange(len(centres)), b.num_rows)
                near = place < probes
                if rest:
                    bound = b.column(2).to_numpy(zero_copy_only=False)
                    near = ~near & (far[row, cell] - radii[cell] <= bound[row] + 1e-6)
                take = pa.array(row[near], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell[near].astype(np.int32))], ["query", "qvector", "cell"])

        kind = queries.schema["query"].dataType.simpleString()
        return staged(map_batches(queries.select("query", "vector", "bound"), run, f"query {kind}, qvector array<double>, cell int"), "vector-looks")

    def _measured(self, looks: DataFrame, k: int) -> DataFrame:
        """query, id, distance: the k best of every block that a query looks into."""
        blocks = self.cells.groupBy("cell").agg((F.max("block") + 1).alias("rblocks"))
        asked = looks.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qblocks"))
        sizes = F.broadcast(staged(blocks.join(asked, "cell"), "vector-blocks"))  # at most MOST_CELLS rows
        left = looks.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("rblocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.col("qblocks")).cast("int").alias("qblock"), "query", "qvector")
        right = self.cells.join(sizes, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "id", "vector")

        def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if queries.empty or rows.empty:
                return pd.DataFrame({"query": queries["query"][:0], "id": rows["id"][:0], "distance": np.zeros(0)})
            ids, out = rows["id"].to_numpy(), []
            vectors = np.stack(rows["vector"].to_numpy())
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                far = np.round(np.sqrt(_distances(np.stack(part["qvector"].to_numpy()), vectors)), DECIMALS)
                n = min(k, len(ids))
                bound = np.partition(far, n - 1, axis=1)[:, n - 1]
                row, col = np.nonzero(far <= bound[:, None])  # ties of the last included
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[row], "id": ids[col], "distance": far[row, col]}).sort_values(["query", "distance", "id"]).groupby("query").head(k))
            return pd.concat(out)

        ship_package(looks.sparkSession)
        kinds = looks.schema["query"].dataType.simpleString(), self.cells.schema["id"].dataType.simpleString()
        keys = ["cell", "block", "qblock"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query {kinds[0]}, id {kinds[1]}, distance double")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        """query, id, distance, place of the k best for each query, cut down in two steps."""
        for parts in (64, 1):
            within = Window.partitionBy("query", "_part").orderBy("distance", "id")
            found = found.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("place", F.row_number().over(within)).where(F.col("place") <= k).drop("_part")
        return found

    def search(self, queries: DataFrame, k: int = 10, *, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query, id, distance, place of the ``k`` nearest rows of each query (query, vector)."""
        kind = self.cells.schema["id"].dataType.simpleString()
        if not len(self.centres):
            return self.cells.sparkSession.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, id {kind}, distance double, place int")
        width = self.centres.shape[1]
        asked = queries.where(F.size("vector") == width).select("query", F.col("vector").cast("array<double>").alias("vector"))
        probes = min(probes or (PROBES if exact else max(PROBES, int(PROBE_SHARE * len(self.centres)) + 1)), len(self.centres))
        first = self._best(self._measured(self._looks(asked.withColumn("bound", F.lit(0.0)), probes), k), k)
        if not exact:
            return first
        first = staged(first.drop("place"), "vector-first")
        bounds = first.groupBy(F.col("query").alias("_q")).agg(F.when(F.count("*") == k, F.max("distance")).alias("_bound"))
        bounded = asked.join(bounds, F.col("query") == F.col("_q"), "left").select("query", "vector", F.coalesce("_bound", F.lit(float("inf"))).alias("bound"))
        return self._best(first.unionByName(self._measured(self._looks(bounded, probes, rest=True), k)), k)
