"""Product codes of vectors with integer codebooks; nearest entries by partial-distance search.

A component x becomes floor(256 * x). A search goes through the dimensions of a part in descending variance of the
codebook. The entry nearest in the first of them is measured completely, and from then on a mask drops every entry whose
distance so far strictly exceeds the best complete one, so ties still go to the lower index. Rows are only read: a round
of fitting sums parts by entry in every task, and what reaches the driver is parts x entries rows.

Defined results: rows without a vector, or with null or non-finite components, are dropped, as are those whose length is
not that of most vectors (the longer on a tie) or cannot be cut into equal parts. Integers are held within +-2**27, so
that distances are exact longs. Null ids come after all others, equal ids in the order of their vectors; with fewer rows
than entries a codebook is shorter. Null labels are one label. Other columns play no part and may have any name.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, staged

SCALE, LIMIT = 256, 1 << 27
#: Rows that a task measures at a time.
BLOCK = 4096
#: Label sums are broadcast up to so many labels; beyond it they are joined by a shuffle.
BROADCAST_LABELS = 100_000


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """entries: integers by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row of ``parts``, by partial-distance search."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    first = (parts[:, order[0], None] - book[None, :, order[0]]) ** 2
    guess = first.argmin(axis=1)
    best = ((parts - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for d in order[1:]:
        so_far = so_far + (parts[row, d] - book[entry, d]) ** 2
        left = so_far <= best[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    # Every row still has its guess. Entries ascend within a row, so the first of the least is the lowest.
    least = np.minimum.reduceat(so_far, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])) if len(row) else so_far
    hit = np.flatnonzero(so_far == least[row])
    lowest = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
    return entry[lowest], least


def _codes(ints: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, error) of rows cut into parts."""
    codes, errors = np.zeros(ints.shape[:2], np.int64), np.zeros(len(ints), np.int64)
    for at in range(0, len(ints), BLOCK):
        block = slice(at, at + BLOCK)
        for p, book in enumerate(books):
            codes[block, p], far = nearest(ints[block, p], book)
            errors[block] += far
    return codes, errors


def _quantised(parts: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            key, label, vectors = batch.columns
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(sizes)
            starts = ends - sizes
            odd = np.r_[0, np.cumsum(~np.isfinite(values))]
            good = np.flatnonzero((sizes > 0) & (sizes % parts == 0) & (odd[ends] == odd[starts]))
            with np.errstate(invalid="ignore"):
                ints = np.clip(np.floor(values * SCALE), -LIMIT, LIMIT)
            made = [ints[starts[i] : ends[i]].astype("<i4").tobytes() for i in good]
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([key.take(take), label.take(take), pa.array(made, pa.binary())], ["id", "label", "ints"])

    return run


def quantised(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16) -> DataFrame:
    """id, label, ints (little-endian 32-bit integers) of the kept rows, as a table in the shared folder."""
    picked = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = [picked.schema[c].dataType.simpleString() for c in ("id", "label")]
    rows = staged(map_batches(picked, _quantised(parts), f"id {kinds[0]}, label {kinds[1]}, ints binary"), "vector-ints")
    size = F.octet_length("ints")
    usual = rows.groupBy(size.alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return rows.where(size == usual["size"]) if usual else rows


def _matrix(column, parts: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _sums(books: np.ndarray):
    """For each part and entry, the number and the componentwise sum of a task's parts."""

    def run(batches):
        import pyarrow as pa

        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _matrix(batch.column(0), parts)
            codes, _ = _codes(ints, books)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], ints[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    return run


def fit_codebooks(rows: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of ``quantised`` rows: the first ``entries`` ids, then ``rounds`` of assigning and averaging (floor). None without rows."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not first:
        return None
    books = np.stack([np.frombuffer(bytes(r["ints"]), "<i4").astype(np.int64).reshape(parts, -1) for r in first], axis=1)
    for _ in range(rounds):
        tasks = map_batches(rows.select("ints"), _sums(books), "part int, entry int, n long, total array<long>")
        width = books.shape[2]
        summed = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
        new = books.copy()
        for r in summed.collect():  # at most parts x entries rows
            new[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
        books = new
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """id, label, code (a byte for each part) and error of ``quantised`` rows."""
    books = codebooks.entries

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes, errors = _codes(_matrix(batch.column(2), len(books)), books) if batch.num_rows else (np.zeros((0, 1)), np.zeros(0, np.int64))
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    return map_batches(rows, run, f"id {kinds[0]}, label {kinds[1]}, code binary, error long")


def decoded(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``codes`` (id, code) with the vector that a code stands for."""
    books = codebooks.entries

    def run(batches):
        import pyarrow as pa

        at = np.arange(len(books))
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
            vectors = books[at, code].reshape(batch.num_rows, -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors.tolist(), pa.list_(pa.float64()))], ["id", "vector"])

    return map_batches(codes.select("id", "code"), run, f"id {codes.schema['id'].dataType.simpleString()}, vector array<double>")


def code_report(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """The key, code (hexadecimal), error, label_error (summed over equal labels) and codebooks_sha256 of every kept row."""
    rows = quantised(vectors, key=key, vector=vector, label=label, parts=parts)
    books = fit_codebooks(rows, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        coded = rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = staged(encode(rows, books), "vector-codes")
    sums = staged(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vector-labels")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    joined = coded.join(side, coded["label"].eqNullSafe(side["_label"]), "left")
    return joined.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
