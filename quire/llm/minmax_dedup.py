"""Near-duplicate groups by min-max hashing with banding, confirmed on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum over the set, so 64 hash evaluations a
shingle give 128 values: 32 bands of two permutations with both ends. At a similarity of 0.8 a pair shares no band
with a probability under 1e-7. Texts with equal shingle sets become one node first, so exact copies are never paired.

Texts that meet in a bucket are tied to the bucket's smallest member only, and the connected components of these ties
are the units of comparison: two texts that share a bucket are always in one unit, and a text is sent to its unit once
instead of once a bucket. A unit is dealt to tasks in blocks: a small one is one block, a larger one is split by a hash
of the key and every two of its blocks meet in one task. A task counts the common shingles of all its texts at once
(matrix products over the frequent shingles, runs of neighbours over the rare ones), compares every pair on the full
sets of 64-bit shingle hashes and gives back a star for each component that it found: rows grow with the texts, not
with their pairs, and no link between components is lost. A unit so large that its buckets have become chained by weak
likeness (over ``CHAINED`` texts) is compared bucket by bucket in the same way.

Defined results: a null text or one without words has no shingle, links with nothing and is its own component; fewer
words than the shingle length are one shingle; repeated rows are copies of each other; null ids are never a
component's smallest, and a component of null ids only has a null id; of a component the rows with the smallest id
(nulls last) and then the smallest digest of the text are kept, whatever ids are shared; very long texts are compared
whole; an empty table gives an empty result; only the id and text columns are read by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import forget, map_batches, sliced, staged
from quire.llm.components import connected_components

PERMUTATIONS, BANDS = 64, 32
#: Texts and shingles of a block; two blocks meet in a task.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 400_000
#: Units of more texts are compared by bucket.
CHAINED = 100_000
#: Shingles that a task of the comparison receives on average.
TASK_SHINGLES = 2_000_000
#: Lists of up to this many digests are broadcast.
BROADCAST_DIGESTS = 500_000
#: Shingles of at least so many texts of a task are counted by matrix products.
FREQUENT = 24
CACHE_WORDS = 100_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 500
SEED = 20240229


class _WordHashes(dict):
    """Stable 64-bit hashes of words, cached."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    length = min(length, len(w))
    n = len(w) - length + 1
    h = np.full(n, length, np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        h ^= h >> np.uint64(29)
    return np.unique(_mixed(h))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(SEED))
    return r.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for at in range(0, len(x), 2048):
        y = a[:, None] * x[None, at : at + 2048] + b[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return low, high


def band_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band: two permutations, both ends; the band's number is part of it."""
    ends = (low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)
    h = _mixed(ends[0::2] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + ends[1::2]).view(np.int64)


def signatures(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_shingles, set_key (128-bit digest of the set) and bands of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = _permutations()
        for batch in sliced(batches, SLICE):
            sizes, keys, bands = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, length)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_hashes(*min_max(s, a, b)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return map_batches(rows, sign, "doc_id long, digest string, n_shingles long, set_key binary, bands array<long>")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right`` (or of ``left``); sets are distinct values."""
    sets = left + (right or [])
    m, n = len(left), len(right or left)
    shared = np.zeros((m, n), np.float32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    often = np.diff(np.append(starts, len(values)))
    # Rare shingles: neighbours at each distance in a run of equal values are a pair of owners (in ascending order).
    each = np.repeat(often, often)
    rare = owner[(each > 1) & (each < FREQUENT)]
    run = np.repeat(np.arange(len(often)), often)[(each > 1) & (each < FREQUENT)]
    for d in range(1, FREQUENT - 1):
        same = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else np.empty(0, np.int64)
        if not len(same):
            break
        x, y = rare[same], rare[same + d]
        if right is not None:
            cross = (x < m) & (y >= m)
            x, y = x[cross], y[cross] - m
        np.add.at(shared.reshape(-1), x.astype(np.int64) * n + y, 1)
    if right is None:
        shared += shared.T
    column = np.cumsum(often >= FREQUENT) - 1
    where = each >= FREQUENT
    columns, rows = np.repeat(column, often)[where], owner[where]
    wide = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, wide, 2048):
        # Values are sorted, so the columns of a stretch stand together.
        a, b = np.searchsorted(columns, (lo, lo + 2048))
        dense = np.zeros((len(sets), min(2048, wide - lo)), np.float32)
        dense[rows[a:b], columns[a:b] - lo] = 1
        shared += dense[:m] @ (dense[:m] if right is None else dense[m:]).T
    if right is None:
        np.fill_diagonal(shared, [len(s) for s in left])
    return shared


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A star (smallest place, place) for each component of the links between ``left`` and ``right``, or within ``left``."""
    m, both = len(left), len(left) + len(right or ())
    sizes = np.array([len(s) for s in left + (right or [])], np.float64)
    shared = common_shingles(left, right)
    other = sizes[m:] if right is not None else sizes
    near = 100 * shared >= percent * (sizes[:m, None] + other[None, :] - shared)
    out, seen = [], np.zeros(both, bool)
    for start in range(m):
        if seen[start]:
            continue
        group, edge = np.zeros(both, bool), np.array([start])
        group[start] = True
        while len(edge):
            reached = np.zeros(both, bool)
            if right is None:
                reached = near[edge].any(axis=0)
            else:
                reached[m:] = near[edge[edge < m]].any(axis=0)
                reached[:m] = near[:, edge[edge >= m] - m].any(axis=1)
            edge = np.flatnonzero(reached & ~group)
            group[edge] = True
        seen |= group
        out += [(start, x) for x in np.flatnonzero(group).tolist() if x != start]
    return out


def _compared(rows: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) found in rows (unit, x, y, block, set_key, text): each (unit, x, y) is one comparison of blocks x and y."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: dict[int, list[bytes]], sets: dict[int, list[np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
            names = [k for block in sorted(keys) for k in keys[block]]
            blocks = [sets[block] for block in sorted(sets)]
            alone = x == y
            if not alone and len(blocks) < 2 or len(names) < 2:
                return [], []
            stars = linked(blocks[0], None if alone else blocks[1], percent)
            return [names[i] for i, _ in stars], [names[j] for _, j in stars]

        def answer(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        unit, x, y = None, 0, 0
        keys: dict[int, list[bytes]] = {}
        sets: dict[int, list[np.ndarray]] = {}
        found: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in sliced(batches, SLICE):
            for u, i, j, block, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (u, i, j) != (unit, x, y):
                    for have, new in zip(found, links(keys, sets)):
                        have.extend(new)
                    unit, x, y, keys, sets = u, i, j, {}, {}
                    if len(found[0]) > 10_000:
                        yield answer(*found)
                        found = ([], [])
                keys.setdefault(block, []).append(key)
                sets.setdefault(block, []).append(shingle_set(text, length))
        for have, new in zip(found, links(keys, sets)):
            have.extend(new)
        yield answer(*found)

    return map_batches(rows, compare, "a binary, b binary")


def _units(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """unit, set_key, blocks, shingles: what is compared with what, and into how many blocks a unit is split."""
    pivots = entries.groupBy("bucket").agg(F.min("set_key").alias("a"), F.count("*").alias("members")).where("members > 1").select("bucket", "a")
    ties = staged(entries.join(pivots, "bucket").where("set_key <> a").select("a", F.col("set_key").alias("b")).distinct(), "dedup-ties")
    clusters = connected_components(ties)
    members = staged(clusters.select(F.col("label").alias("unit"), F.col("node").alias("set_key")).join(sets.select("set_key", "n"), "set_key"), "dedup-members")
    forget(ties, clusters)
    count = lambda rows: rows.groupBy("unit").agg(F.count("*").alias("_texts"), F.sum("n").alias("_shingles"))
    sizes = staged(count(members), "dedup-units")
    if sizes.where(F.col("_texts") > CHAINED).limit(1).count():
        loose = members.join(sizes.where(F.col("_texts") > CHAINED).select("unit"), "unit", "left_semi").select("set_key", "n")
        by_bucket = entries.join(loose, "set_key").select(F.col("bucket").cast("string").cast("binary").alias("unit"), "set_key", "n")
        members = staged(members.join(sizes.where(F.col("_texts") <= CHAINED).select("unit"), "unit", "left_semi").select("unit", "set_key", "n").unionByName(by_bucket), "dedup-members")
        sizes = staged(count(members).where("_texts > 1"), "dedup-units")
    blocks = F.ceil(F.greatest(F.col("_texts") / BLOCK_TEXTS, F.col("_shingles") / BLOCK_SHINGLES)).cast("int")
    return members.join(sizes.select("unit", blocks.alias("blocks")), "unit").select("unit", "set_key", "n", "blocks")


def _links(docs: DataFrame, sets: DataFrame, length: int, percent: int) -> DataFrame:
    """a, b: links between set keys with the same components as all links have."""
    entries = sets.select(F.explode("bands").alias("bucket"), "set_key")
    units = staged(_units(sets, entries), "dedup-pairs")
    wanted = staged(units.select("set_key").distinct().join(sets.select("set_key", "digest"), "set_key"), "dedup-wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_DIGESTS else wanted
    # One text for each set that meets another in a bucket; copies with the same digest are dropped before the shuffle.
    texts = docs.select("text", F.md5(F.col("text").cast("binary")).alias("digest")).join(side, "digest").select("set_key", "text").dropDuplicates(["set_key"])
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    dealt = units.select("unit", "set_key", own, "blocks").select("unit", "set_key", "block", meets)
    dealt = dealt.select("unit", F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y"), "block", "set_key")
    volume = units.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    parts = max(8, -(-volume // TASK_SHINGLES))
    rows = texts.join(dealt, "set_key").select("unit", "x", "y", "block", "set_key", "text")
    rows = rows.repartition(parts, "unit", "x", "y").sortWithinPartitions("unit", "x", "y", "block", "set_key")
    links = staged(_compared(rows, length, percent), "dedup-links")
    forget(units, wanted)
    return links


def _verdicts(docs: DataFrame, length: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The report, and the staged tables that it reads."""
    signed = staged(signatures(docs, length), "dedup-signatures")
    sets = signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "digest")).alias("first"), F.count("*").alias("copies"), F.min("digest").alias("digest"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    sets = staged(sets, "dedup-sets")
    links = _links(docs, sets, length, percent)
    labels = connected_components(links)
    named = sets.select("set_key", "first", "copies").join(labels, sets["set_key"] == labels["node"], "left")
    grouped = named.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = staged(named.drop("node").where("copies > 1 or label is not null").join(grouped, "label", "left").select("set_key", F.coalesce("least", "first").alias("_first")), "dedup-names")
    forget(links, labels, sets)
    out = signed.select("doc_id", "digest", "n_shingles", "set_key").join(named, "set_key", "left")
    # An id may be null or shared by near copies, so the survivor is told by its text as well; a set on its own has no _first.
    survives = F.col("_first").isNull() | (F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("digest") == F.col("_first.digest")))
    out = out.select("doc_id", "digest", "n_shingles", F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("component_id"), survives.alias("kept"))
    return out, [signed, named]


def near_duplicates(docs: DataFrame, *, length: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, digest, n_shingles, component_id and kept of every row of ``docs``."""
    return _verdicts(docs, length, percent)[0]


def deduplicated(docs: DataFrame, *, length: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group.

    Texts are not shuffled while the lists of ids that go, and of rows that are repeated, are short enough to broadcast.
    """
    verdicts, tables = _verdicts(docs, length, percent)
    fate = verdicts.groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    fate = staged(fate.where("not _kept or _rows > 1"), "dedup-fate")
    forget(*tables)
    side = F.broadcast(fate) if fate.count() <= BROADCAST_DIGESTS else fate
    rows = docs.withColumn("_own", F.md5(F.col("text").cast("binary")))
    same = rows["doc_id"].cast("long").eqNullSafe(side["_doc"]) & rows["_own"].eqNullSafe(side["_digest"])
    single = rows.join(side, same, "left_anti").select(*docs.columns)
    if not fate.where("_kept").limit(1).count():
        return single
    # Repeated rows are copies too: of those that are kept, one row stays.
    again = fate.where("_kept")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    repeated = rows.join(again, rows["doc_id"].cast("long").eqNullSafe(again["_doc"]) & rows["_own"].eqNullSafe(again["_digest"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_own").orderBy("doc_id"))
    return single.unionByName(repeated.withColumn("_place", first).where("_place = 1").select(*docs.columns))
