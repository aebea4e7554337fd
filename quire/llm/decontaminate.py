"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. Seeds, hashes of ``SEED_WORDS`` words, join
documents with benchmark items: an item gives a seed at each word, a document at every ``stride``-th word, which
misses no match of ``min_match`` words or more. Each (document, item) pair that shares a seed is tiled: running
Karp-Rabin hashes find the longest common runs of unmarked words, the longest is marked in both texts, and so on until
no run of ``min_match`` words is left. A tile of L words holds a document seed for every ``words_per_seed`` of its words
at least, so pairs that share too few seed places for tiles of ``min_coverage`` are passed over before texts are joined;
no pair that leaks is lost by it. Tiles do not overlap but may stand in any order, so reordered passages count.
A document leaks an item if its tiles cover at least ``min_coverage`` of the item's words.

Defined results: null or empty texts share nothing; an item shorter than ``min_match`` words is matched whole, as one
run; documents that are equal in id and text get their rows once; items are told apart by id and text, so texts that share an item id or
have none are each tiled and each get their row; an empty table on either side gives no rows; only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, staged

MIN_MATCH = 6
SEED_WORDS = 4
MIN_COVERAGE = 0.5
#: Seed tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SEEDS = 2_000_000
BREAK = "[^\\p{L}\\p{M}\\p{N}]+"
BASE = 0x9E3779B97F4A7C15


def normal_words(text: Column) -> Column:
    """The runs of letters, marks and digits of the lower-case text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def seeds(word_array: Column, step: int) -> Column:
    """Hashes of the seeds at every ``step``-th word; shorter texts are one seed."""
    last = F.greatest(F.size(word_array) - SEED_WORDS + 1, F.lit(1))
    whole = F.size(word_array) > 0
    return F.when(whole, F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.xxhash64(F.slice(word_array, i, SEED_WORDS)))).otherwise(F.array().cast("array<bigint>"))


def stride(min_match: int) -> int:
    """How far a document's seeds may stand apart for every match of ``min_match`` words to hold one."""
    return max(1, min_match - SEED_WORDS + 1)


def words_per_seed(min_match: int) -> int:
    """The most words of a tile for each of its document seeds: one more word and it would hold another seed."""
    return 2 * stride(min_match) + SEED_WORDS - 2


def _windows(w: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows, from running sums."""
    up = np.cumprod(np.full(len(w), BASE, np.uint64))
    down = np.cumprod(np.full(len(w), pow(BASE, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * down, dtype=np.uint64)])
    # The base is odd and so has an inverse: scaled by the power of its start, a window's sum does not show its place.
    return (total[length:] - total[:-length]) * up[: len(w) - length + 1]


def tiles(doc: list[str], item: list[str], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the tiles, longest first."""
    length = min(min_match, len(item))
    if not length or len(doc) < length:
        return []
    number: dict[str, int] = {}
    coded = lambda xs: np.array([number.setdefault(x, len(number) + 1) for x in xs], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    b, a = coded(item), coded(doc)
    hits: dict[int, list[int]] = {}
    for k, h in enumerate(_windows(b, length).tolist()):
        hits.setdefault(h, []).append(k)
    ha = _windows(a, length)
    near = np.flatnonzero(np.isin(ha, np.fromiter(hits, np.uint64, len(hits))))
    # Maximal runs: consecutive window hits on one diagonal, confirmed word by word.
    ends: dict[int, int] = {}
    runs: list[tuple[int, int, int]] = []
    for i in near.tolist():
        for k in hits[int(ha[i])]:
            if ends.get(i - k, -1) > i or doc[i : i + length] != item[k : k + length]:
                continue
            n = length
            while i + n < len(doc) and k + n < len(item) and doc[i + n] == item[k + n]:
                n += 1
            ends[i - k] = i + n - length + 1
            runs.append((i, k, n))
    used_a, used_b = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, k, n in runs:
        by_size.setdefault(n, []).append((i, k))
    out = []
    while by_size:
        n = max(by_size)
        for i, k in sorted(by_size.pop(n)):
            free = ~(used_a[i : i + n] | used_b[k : k + n])
            if free.all():
                used_a[i : i + n] = used_b[k : k + n] = True
                out.append((i, k, n))
                continue
            # Parts of the run that are still unmarked wait for their turn.
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                if hi - lo >= length:
                    by_size.setdefault(hi - lo, []).append((i + lo, k + lo))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, digest, item_id, coverage, tiles, tile_words and longest of every (document, item) pair that leaks."""
    named = benchmark.select("item_id", F.md5(F.col("text").cast("binary")).alias("item_digest"), normal_words(F.col("text")).alias("_iw")).where(F.size("_iw") > 0)
    items = named.dropDuplicates(["item_digest"]).select("item_digest", "_iw")
    size = F.size("_iw")
    need = F.when(size < min_match, 1).otherwise(F.greatest(F.lit(1), F.ceil(size * min_coverage / words_per_seed(min_match)))).cast("long")
    known = staged(items.select("item_digest", need.alias("need"), F.explode(F.array_distinct(seeds(F.col("_iw"), 1))).alias("seed")), "leak-seeds")
    rows = docs.select(F.col("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), normal_words(F.col("text")).alias("_w"))
    # Items under the seed's length are one seed of their own size; documents then need every start of that size.
    sizes = [r["n"] for r in items.where(size < min_match).select(size.alias("n")).distinct().collect()]
    found = seeds(F.col("_w"), stride(min_match))
    for n in sizes:
        found = F.concat(found, F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.xxhash64(F.slice("_w", i, min(n, SEED_WORDS))))).otherwise(F.array().cast("array<bigint>")))
    spread = rows.select("doc_id", "digest", F.explode(found).alias("seed"))
    side = F.broadcast(known) if known.count() <= BROADCAST_SEEDS else known
    # The rows of a document stay together up to here, so most of its pairs become one before the shuffle. A seed is in
    # an item's list once, so the rows of a pair are the document's places that it shares.
    pairs = spread.join(side, "seed").groupBy("doc_id", "digest", "item_digest").agg(F.count("*").alias("places"), F.first("need").alias("need"))
    pairs = staged(pairs.where("places >= need").select("doc_id", "digest", "item_digest"), "leak-pairs")
    wanted = pairs.select("digest").distinct()
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST_SEEDS else wanted
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", normal_words(F.col("text")).alias("_w"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("digest", pa.string()), ("item_digest", pa.string()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("tile_words", pa.int64()), ("longest", pa.int64())])
        for b in batches:
            out = []
            for digest, item_digest, doc, item in zip(*[c.to_pylist() for c in b.columns]):
                t = tiles(doc, item, min_match)
                words = sum(x[2] for x in t)
                if words >= min_coverage * len(item):
                    out.append({"digest": digest, "item_digest": item_digest, "coverage": words / len(item), "tiles": len(t), "tile_words": words, "longest": t[0][2]})
            yield pa.RecordBatch.from_pylist(out, types)

    # Equal texts, of documents and of items, are tiled once; digests are never null, item ids may be.
    work = pairs.select("digest", "item_digest").distinct().join(texts, "digest").join(items, "item_digest").select("digest", "item_digest", "_w", "_iw")
    verdicts = map_batches(work, tile, "digest string, item_digest string, coverage double, tiles int, tile_words long, longest long")
    verdicts = staged(verdicts, "leak-verdicts")
    ids = named.select("item_id", "item_digest").distinct()
    return pairs.join(verdicts, ["digest", "item_digest"]).join(ids, "item_digest").select("doc_id", "digest", "item_id", "coverage", "tiles", "tile_words", "longest")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    bad = staged(leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct(), "leak-documents")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_SEEDS else bad
    own = F.md5(docs["text"].cast("binary"))
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_doc"]) & own.eqNullSafe(side["_digest"]), "left_anti")
