"""An inverted index in immutable segments: it grows by what changed, and a top-k search passes over blocks that cannot count.

A batch of changes becomes one segment. Its ``docs`` hold each document's tokens, its ``blocks`` the postings of a term in
a range of up to some thousand neighbouring documents and a million tokens; documents lie in the order of their lengths
within a task. A document that is replaced or deleted is noted in a ``gone`` table under the segment that holds its dead
version, with the terms that its death takes from their frequencies. Segments of like size are merged from their tokens, without reading texts again. The
list of what is alive is a numbered manifest, which comes to its name by a rename that fails where another writer was
faster; a batch that dies before leaves files that no manifest names.

A block keeps the pairs (frequency, length) that no other posting of it beats in both. BM25 grows with the frequency and
falls with the length, so its greatest part in a score is exact for any mean length. A search adds these bounds up by range,
scores the few best ranges whole, and then only the ranges whose bound reaches the k-th best score so found.

Keys of a batch are distinct and not null; an absent key may be deleted. Nothing is collected but the query's terms, a few
ranges and one row for each segment.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import K1, LEAST_IDF, TOKEN, B, Index, tokens
from quire.sources.manifests import Folder, Manifests
from quire.sources.shipping import map_batches
from quire.sources.storage import staged

#: Documents of a range; segments that are merged at a time; documents for each folder that terms are spread over.
BLOCK_DOCS, FANOUT, SHARD_DOCS = 1024, 8, 1_000_000
#: Tokens of a range of more than one document, which bound a task's memory: the longest documents of a task are neighbours.
BLOCK_TOKENS = 1_000_000
#: The bits of a place below its task.
TASK_BITS = 33
#: Ranges that are scored to find the threshold.
FIRST_RANGES = 8
#: Dead keys and kept ranges are broadcast up to so many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Sums of bounds and of scores may differ in their last bits.
SLACK = 1e-9
#: Decimals of a score unless a search gives others; as many as make the scores of equal texts the same, in whatever order they are summed.
DIGITS = 12


@dataclasses.dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    tokens: int
    shards: int
    key: str
    dead_docs: int = 0
    dead_tokens: int = 0


@dataclasses.dataclass(frozen=True)
class Manifest:
    """What is alive: segments, and the tables of dead versions with the segments that each is about."""

    number: int = 0
    segments: tuple[Segment, ...] = ()
    gone: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def docs(self) -> int:
        return sum(s.docs - s.dead_docs for s in self.segments)

    @property
    def tokens(self) -> int:
        return sum(s.tokens - s.dead_tokens for s in self.segments)

    @classmethod
    def of(cls, content: dict) -> Manifest:
        return cls(content["number"], tuple(Segment(**s) for s in content["segments"]), tuple((n, tuple(s)) for n, s in content["gone"]))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _block_rows(rows: pa.Table, weights: list[float], positions: bool) -> pa.RecordBatch:
    """A row for each term of the documents (place, key, n, tokens) of one range, which is named by its first place."""

    def lists(ends, values):
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)

    n = rows["n"].to_numpy()
    fields = rows["tokens"].combine_chunks().flatten()
    words = fields.flatten().dictionary_encode()
    counts = pc.list_value_length(fields).to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(len(counts)), counts)
    # Tokens of one term and document follow each other; a run of them is a posting.
    posting = words.indices.to_numpy().astype(np.int64) * rows.num_rows + cell // len(weights)
    order = np.argsort(posting, kind="stable")
    cell, posting = cell[order], posting[order]
    starts = np.flatnonzero(np.append(True, posting[1:] != posting[:-1]))
    term, doc = np.divmod(posting[starts], rows.num_rows)
    f = np.zeros(len(starts))
    for i, w in enumerate(weights):
        f += w * np.add.reduceat((cell % len(weights) == i).astype(np.int64), starts)
    df = np.bincount(term, minlength=len(words.dictionary))
    # Shortest first, a pair counts if its frequency is above all before it; a lone posting is its own bound.
    by = np.lexsort((-f, n[doc], term))
    rank = np.unique(f, return_inverse=True)[1][by] + term[by] * (len(f) + 1)
    above = np.append(True, rank[1:] > np.maximum.accumulate(rank)[:-1])
    top = by[above & (f[by] > 0) & (df[term[by]] > 1)]
    top_ends, ends = np.cumsum(np.bincount(term[top], minlength=len(df))), np.cumsum(df)
    columns = [words.dictionary.cast(pa.string()), pa.array(np.full(len(df), rows["place"][0].as_py()), pa.int64()), pa.array(df, pa.int64()), lists(top_ends, pa.array(f[top])), lists(top_ends, pa.array(n[doc[top]], pa.int64()))]
    columns += [lists(ends, rows["key"].combine_chunks().take(pa.array(doc))), lists(ends, pa.array(f)), lists(ends, pa.array(n[doc], pa.int64()))]
    names = ["term", "range", "df", "top_f", "top_n", "keys", "f", "n"]
    if positions:
        at = np.arange(len(cell)) - np.repeat(np.cumsum(counts) - counts, counts)
        spots = pa.StructArray.from_arrays([pa.array(cell % len(weights), pa.int32()), pa.array(at[order], pa.int32())], ["field", "at"])
        columns.append(lists(ends, lists(np.append(starts[1:], len(cell)), spots)))
        names.append("places")
    return pa.RecordBatch.from_arrays(columns, names)


def _blocks_of(weights: list[float], block_docs: int, block_tokens: int, positions: bool):
    """Documents of neighbouring places to a row for each term of a range, which ends before it holds too many documents or tokens."""

    def run(batches):
        held, docs, total, task = [], 0, 0, None

        def closed():
            rows = pa.Table.from_batches(held)
            held.clear()
            # Documents without a token are in no block.
            if total:
                yield _block_rows(rows, weights, positions)

        for batch in batches:
            start = 0
            for i, (place, n) in enumerate(zip(batch.column("place").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if docs and (docs == block_docs or total + n > block_tokens or place >> TASK_BITS != task):
                    held.append(batch.slice(start, i - start))
                    yield from closed()
                    start, docs, total = i, 0, 0
                docs, total, task = docs + 1, total + n, place >> TASK_BITS
            held.append(batch.slice(start))
        if docs:
            yield from closed()

    return run


class SegmentedIndex:
    """The index under ``path``; ``weights`` names the text columns of a batch, ``payload`` columns that are kept with a document."""

    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float], *, fold: bool = False, stem: bool = False, token: str = TOKEN, positions: bool = False, payload: tuple[str, ...] = (), block_docs: int = BLOCK_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.weights, self.fold, self.stem, self.token = spark, path.rstrip("/"), weights, fold, stem, token
        self.positions, self.payload, self.block_docs, self.fanout = positions, tuple(payload), block_docs, fanout
        self._manifests = Manifests(spark, self.path)

    # -- manifests -------------------------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        _, content = self._manifests.latest()
        return Manifest.of(content) if content else Manifest()

    def _commit(self, new: Manifest) -> Manifest:
        self._manifests.commit(new.number, dataclasses.asdict(new))
        return new

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` manifests and every folder that those do not name; how many folders. No writer may be at work."""
        alive = [Manifest.of(c) for c in self._manifests.prune(keep)]
        used = {s.name for m in alive for s in m.segments} | {n for m in alive for n, _ in m.gone}
        deleted = 0
        for kind in ("segments", "gone"):
            folder = Folder(self.spark, f"{self.path}/{kind}")
            for n in folder.names():
                if n not in used:
                    folder.delete(n)
                    deleted += 1
        return deleted

    # -- reading ---------------------------------------------------------------------------------------------

    def _dead_keys(self, m: Manifest, segment: Segment) -> DataFrame:
        found = [self.spark.read.parquet(f"{self.path}/gone/{n}/keys").where(F.col("segment") == segment.name).select("key") for n, about in m.gone if segment.name in about]
        return _union(found)

    def _live(self, rows: DataFrame, m: Manifest, segment: Segment) -> DataFrame:
        """Rows (key, ...) of a segment without those of dead versions."""
        if not segment.dead_docs:
            return rows
        dead = self._dead_keys(m, segment)
        return rows.join(F.broadcast(dead) if segment.dead_docs <= BROADCAST_ROWS else dead, "key", "left_anti")

    def documents(self, m: Manifest | None = None) -> DataFrame:
        """segment, key, n, tokens and the payload of every live document; the index must hold a segment."""
        m = m or self.manifest()
        return _union([self._live(self.spark.read.parquet(f"{self.path}/segments/{s.name}/docs"), m, s).drop("place").withColumn("segment", F.lit(s.name)) for s in m.segments])

    def _block_schema(self, key: str) -> str:
        places = ", places array<array<struct<field:int,at:int>>>" if self.positions else ""
        return f"term string, range long, df long, top_f array<double>, top_n array<long>, keys array<{key}>, f array<double>, n array<long>{places}"

    def _segment_blocks(self, s: Segment) -> DataFrame:
        rows = self.spark.read.schema(f"{self._block_schema(s.key)}, shard int").parquet(f"{self.path}/segments/{s.name}/blocks")
        return rows.withColumn("segment", F.lit(s.name))

    def _blocks(self, m: Manifest, terms: list[str]) -> DataFrame:
        """The blocks of the terms, dead versions included; a term lies in one folder of a segment."""
        found = []
        for s in m.segments:
            shards = sorted({zlib.crc32(t.encode()) % s.shards for t in terms})
            found.append(self._segment_blocks(s).where(F.col("shard").isin(shards) & F.col("term").isin(terms)).drop("shard"))
        return _union(found)

    def _postings(self, blocks: DataFrame, m: Manifest) -> DataFrame:
        """segment, term, key, f, n (and places) of live documents."""
        parts = ["keys", "f", "n", *(["places"] if self.positions else [])]
        row = F.explode(F.arrays_zip(*parts)).alias("p")
        flat = blocks.select("segment", "term", row).select("segment", "term", F.col("p.keys").alias("key"), *[f"p.{c}" for c in parts[1:]])
        touched = [s for s in m.segments if s.dead_docs]
        if not touched:
            return flat
        dead = _union([self._dead_keys(m, s).withColumn("segment", F.lit(s.name)) for s in touched])
        return flat.join(F.broadcast(dead) if sum(s.dead_docs for s in touched) <= BROADCAST_ROWS else dead, ["segment", "key"], "left_anti")

    def as_index(self) -> Index:
        """All live postings as a plain index, for phrases."""
        m = self.manifest()
        blocks = _union([self._segment_blocks(s).drop("shard") for s in m.segments])
        return Index(self._postings(blocks, m).drop("segment", "n"), self.documents(m).select("key", "n"), fold=self.fold, stem=self.stem)

    # -- writing ---------------------------------------------------------------------------------------------

    def _write_segment(self, docs: DataFrame) -> Segment:
        """A segment of documents (key, tokens, n, payload), which may be none."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        places = docs.select("key", "n", "tokens", *self.payload).sortWithinPartitions("n", "key").withColumn("place", F.monotonically_increasing_id())
        places.write.parquet(f"{folder}/docs")
        written = self.spark.read.schema(places.schema).parquet(f"{folder}/docs")
        count, total = written.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        shards = 1 + count // SHARD_DOCS
        key = written.schema["key"].dataType.simpleString()
        blocks = map_batches(written.select("place", "key", "n", "tokens"), _blocks_of(list(self.weights.values()), self.block_docs, BLOCK_TOKENS, self.positions), self._block_schema(key))
        blocks = blocks.withColumn("shard", (F.crc32(F.col("term").cast("binary")) % shards).cast("int"))
        if shards > 1:
            # A shard's blocks are brought together; a frequent term's go to many tasks, each with some ranges of it.
            blocks = blocks.repartition("shard", F.floor(F.col("range") / (16 * self.block_docs)))
        blocks.sortWithinPartitions("shard", "term", "range").write.partitionBy("shard").parquet(f"{folder}/blocks")
        return Segment(name, count, int(total), shards, key)

    def _tokenised(self, rows: DataFrame) -> DataFrame:
        found = F.array(*[tokens(F.col(c), fold=self.fold, stem=self.stem, token=self.token) for c in self.weights])
        return rows.select("key", found.alias("tokens"), *self.payload).withColumn("n", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.size(t)))

    def apply(self, rows: DataFrame, gone: DataFrame | None = None) -> Manifest:
        """Takes in a batch: new and changed documents (key, text columns, payload), and the keys of deleted ones."""
        m = self.manifest()
        segments, buried = list(m.segments), list(m.gone)
        if segments:
            touched = rows.select("key") if gone is None else rows.select("key").unionByName(gone.select("key"))
            touched = staged(touched.distinct(), "touched")
            name = uuid.uuid4().hex
            old = self.documents(m).select("segment", "key", "n", F.array_distinct(F.flatten("tokens")).alias("terms"))
            old = staged(old.join(F.broadcast(touched) if touched.count() <= BROADCAST_ROWS else touched, "key", "left_semi"), "dead")
            died = {r["segment"]: (r["docs"], r["tokens"]) for r in old.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).collect()}
            if died:
                old.select("segment", "key").write.parquet(f"{self.path}/gone/{name}/keys")
                lost = old.select("segment", F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df"))
                lost.sortWithinPartitions("term").write.parquet(f"{self.path}/gone/{name}/terms")
                buried.append((name, tuple(sorted(died))))
                segments = [dataclasses.replace(s, dead_docs=s.dead_docs + died[s.name][0], dead_tokens=s.dead_tokens + died[s.name][1]) if s.name in died else s for s in segments]
        made = self._write_segment(self._tokenised(rows))
        return self._commit(self._tidied(Manifest(m.number + 1, (*segments, made) if made.docs else tuple(segments), tuple(buried))))

    @staticmethod
    def _tidied(m: Manifest) -> Manifest:
        """Without segments that are all dead and tables about none that is left."""
        alive = tuple(s for s in m.segments if s.docs > s.dead_docs)
        names = {s.name for s in alive}
        return Manifest(m.number, alive, tuple((n, about) for n, about in m.gone if names & set(about)))

    def compact(self) -> bool:
        """Merges the smallest tier that has ``fanout`` segments; false if none has. Tokens are not made again."""
        m = self.manifest()
        tiers: dict[int, list[Segment]] = {}
        for s in m.segments:
            tiers.setdefault(int(math.log(max(s.docs, 1), self.fanout)), []).append(s)
        full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
        if not full:
            return False
        merged = tiers[full[0]]
        live = self.documents(Manifest(m.number, tuple(merged), m.gone))
        files = max(1, sum(s.docs for s in merged) // (16 * self.block_docs))
        made = self._write_segment(live.coalesce(files))
        left = tuple(s for s in m.segments if s not in merged)
        self._commit(self._tidied(Manifest(m.number + 1, (*left, made), m.gone)))
        return True

    # -- searching -------------------------------------------------------------------------------------------

    def _idfs(self, m: Manifest, blocks: DataFrame, terms: list[str]) -> dict[str, float]:
        """idf of the terms that live documents hold; one row for each term of the query."""
        counts = [blocks.select("term", "df")]
        names = [s.name for s in m.segments]
        for n, _ in m.gone:
            lost = self.spark.read.parquet(f"{self.path}/gone/{n}/terms").where(F.col("term").isin(terms) & F.col("segment").isin(names))
            counts.append(lost.select("term", (-F.col("df")).alias("df")))
        found = {r["term"]: r["df"] for r in _union(counts).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        return {t: max(math.log((m.docs - df + 0.5) / (df + 0.5)), LEAST_IDF) for t, df in found.items() if df > 0}

    def _part(self, idfs: dict[str, float], mean: float):
        """A posting's part in a score, as a function of its frequency and length."""
        idf = F.element_at(F.create_map(*[F.lit(x) for kv in idfs.items() for x in kv]), F.col("term"))
        return lambda f, n: idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / F.lit(mean)))

    def _plan(self, terms: list[str], k: int, allowed: DataFrame | None, digits: int = DIGITS, mean: float | None = None):
        """(manifest, blocks, bounds by range as a staged table, scorer of blocks, threshold); None where no live document holds a term."""
        m, terms = self.manifest(), sorted(set(terms))
        if not terms or not m.docs:
            return None
        blocks = self._blocks(m, terms)
        idfs = self._idfs(m, blocks, terms)
        if not idfs:
            return None
        blocks = blocks.where(F.col("term").isin(sorted(idfs)))
        part = self._part(idfs, m.tokens / m.docs if mean is None else mean)

        def scored(some: DataFrame) -> DataFrame:
            rows = self._postings(some, m)
            rows = rows if allowed is None else rows.join(allowed.select("key").distinct(), "key", "left_semi")
            return rows.groupBy("key").agg(F.round(F.sum(part(F.col("f"), F.col("n"))), digits).alias("total"))

        bound = F.when(F.col("df") == 1, part(F.col("f")[0], F.col("n")[0])).otherwise(F.array_max(F.transform(F.arrays_zip("top_f", "top_n"), lambda x: part(x["top_f"], x["top_n"]))))
        bounds = staged(blocks.select("segment", "range", "df", bound.alias("bound")).groupBy("segment", "range").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks"), F.sum("df").alias("postings")), "bounds")
        first = bounds.orderBy(F.col("bound").desc(), "segment", "range").limit(FIRST_RANGES).select("segment", "range").collect()
        best = scored(blocks.where(_either([(F.col("segment") == s) & (F.col("range") == r) for s, r in first]))).orderBy(F.col("total").desc()).limit(k)
        count, least = best.agg(F.count("*"), F.min("total")).first()
        # What is rounded up to the k-th best may tie with it, and have the lesser key.
        return m, blocks, bounds, scored, max(least - 0.5 * 10**-digits, 0.0) if count == k else 0.0

    def top(self, terms: list[str], k: int, allowed: DataFrame | None = None, *, digits: int = DIGITS, mean: float | None = None) -> DataFrame:
        """key, score (lower is better) of the best ``k`` live documents that hold a term; of ``allowed`` keys only, if given.

        Scores are rounded to ``digits`` before they are compared, ties go by key. ``mean`` stands in for the mean length of live documents.
        """
        planned = self._plan(terms, k, allowed, digits, mean)
        if planned is None:
            found = self.manifest().segments
            return self.spark.createDataFrame([], f"key {found[0].key if found else 'string'}, score double")
        _, blocks, bounds, scored, least = planned
        kept = bounds.where(F.col("bound") >= least * (1 - SLACK)).select("segment", "range")
        kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
        return scored(blocks.join(kept, ["segment", "range"], "left_semi")).select("key", (-F.col("total")).alias("score")).orderBy("score", "key").limit(k)

    def pruning(self, terms: list[str], k: int) -> DataFrame:
        """One row: ranges, blocks and postings of the terms, and those that ``top`` scores after its threshold."""
        planned = self._plan(terms, k, None)
        if planned is None:
            return self.spark.createDataFrame([(0,) * 6], "ranges long, kept_ranges long, blocks long, kept_blocks long, postings long, kept_postings long")
        _, _, bounds, _, least = planned
        kept = F.col("bound") >= least * (1 - SLACK)
        sums = [("ranges", F.lit(1)), ("blocks", F.col("blocks")), ("postings", F.col("postings"))]
        return bounds.agg(*[x for name, c in sums for x in (F.sum(c).cast("long").alias(name), F.sum(F.when(kept, c).otherwise(0)).cast("long").alias(f"kept_{name}"))])


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
