"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point. A trigram binds the letter vectors,
each permuted (rotated) by its place, by multiplication; a text bundles its trigrams by addition; a language's
prototype bundles the normalised vectors of its labelled texts. The mean of all prototypes is taken from each of them,
since what all languages share tells none from another, so the score is a cosine with what sets a language apart. A text
gets the language whose prototype has the largest cosine with it, ties going to the first in code point order; languages
that are learned from the same texts have no difference and tie at 0.

Prototypes are fitted on a bounded sample of labelled rows outside the held-out fold: about ``ROWS_PER_LANGUAGE`` of
each language, chosen by a hash of the id. Every text is predicted, whole. Language values, one vector each, are the
only thing sent to the driver.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything if no row is labelled;
a null id counts as the empty text in the fold's checksum; repeated rows each get a row; an empty table gives an empty
result; only id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches

DIMENSIONS = 1024
ROWS_PER_LANGUAGE = 2000
CACHE_TRIGRAMS = 60_000
SEED = 77
UNKNOWN = "und"
#: Prototypes closer than this to the mean of all are the same as it.
LEAST_DIFFERENCE = 1e-6


class Profiler:
    """Text vectors; trigram vectors stay in a bounded cache."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.matrix = np.zeros((1024, dimensions), np.int8)
        self.is_letter = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = (np.random.Generator(np.random.PCG64([SEED, c])).integers(0, 2, self.dimensions, np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def _learn(self, gram: int) -> int:
        if len(self.row) == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        k = self.row[gram] = len(self.row)
        self.matrix[k] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return k

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the lower-case letters, words parted by one space, and their counts."""
        if not text:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = c < 1 << 16
        letter = self.is_letter[np.where(low, c, 0)]
        if not low.all():
            letter = letter | ~low & np.array([x > 0xFFFF and chr(x).isalpha() for x in c.tolist()])
        if not letter.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        c = np.where(letter, c, 32)
        c = np.concatenate([[32], c, [32]]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
        return np.unique(g, return_counts=True)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text's trigrams, null without a letter."""
        grams, counts = self.trigrams(text)
        if not len(grams):
            return None
        if len(self.row) > CACHE_TRIGRAMS:
            self.row.clear()
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(grams), 2048):
            rows = [self.row[g] if g in self.row else self._learn(g) for g in grams[at : at + 2048].tolist()]
            total += counts[at : at + 2048].astype(np.float32) @ self.matrix[rows].astype(np.float32)
        return total


_profilers: dict[int, Profiler] = {}


def profiler(dimensions: int) -> Profiler:
    """One profiler for each worker process."""
    if dimensions not in _profilers:
        _profilers[dimensions] = Profiler(dimensions)
    return _profilers[dimensions]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, *, dimensions: int = DIMENSIONS, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): unit vectors, one row a language."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    parts = spark.createDataFrame([(r["lang"], min(1 << 20, 1 + int((1 << 20) * rows_per_language / r["count"]))) for r in counts], "lang string, part int")
    sample = known.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("part")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = profiler(dimensions), {}
        for b in batches:
            for lang, text in zip(*[c.to_pylist() for c in b.columns]):
                v = own.vector(text)
                if v is not None and (size := float(np.linalg.norm(v))):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / size
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = map_batches(sample, bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in sums})
    place = {x: i for i, x in enumerate(langs)}
    out = np.zeros((len(langs), dimensions), np.float64)
    for r in sums:
        out[place[r["lang"]], r["k"]] = r["x"]
    # What all languages share says nothing about any of them. Sums differ in their last digits with the order of tasks:
    # rounding them, and taking what is left of equal prototypes as nothing, keeps reruns and ties the same.
    out = np.round(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), 9)
    if len(langs) > 1:
        out -= out.mean(axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.where(size < LEAST_DIFFERENCE, 0.0, out / np.maximum(size, LEAST_DIFFERENCE))
    return langs, np.round(out, 6).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    dimensions = prototypes.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiler(dimensions)
        for b in batches:
            best, scores = [], []
            for text in b.column(2).to_pylist():
                v = own.vector(text) if langs else None
                if v is None:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                k = int(np.argmax(cosine))
                best.append(langs[k])
                scores.append(min(1.0, max(0.0, float(cosine[k]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, judge, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fits on the labelled rows of ``docs`` and predicts all of them."""
    return predict(docs, *fit(docs, **options))
