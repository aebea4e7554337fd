"""Exact deduplication by distributed MSD radix partitioning: equal texts meet because their bytes do; no digest decides.

A level of Spark splits every open group by the next bytes of its texts and counts the parts. A part with a single text
is done, and so is one in which all texts have ended: they are equal. A part of few rows moves to one task, which splits
it on by successive bytes in the same way; only parts of many rows meet the next level, whose digit is four times as
wide, so that the longest text ends after a logarithm of its length. Rows of a large group of copies are counted where
they lie (with a partial aggregation) and never move together.

Defined results: null texts count as empty; only A-Z are lower-cased; of equal texts the largest id stays, null ids
below all others, and of rows equal in id and text one stays; an empty table gives an empty result; other columns play
no part and may have any name.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, staged

#: Bytes of the first level's digit, and how much wider each next one is.
FIRST_DIGIT, WIDENING = 32, 4
#: Parts of up to so many rows and bytes are split within one task.
LEAF_ROWS, LEAF_BYTES = 1000, 16 << 20
#: Open parts are broadcast up to this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def radix_classes(texts: list[bytes], digit: int = 8) -> list[list[int]]:
    """Positions of equal texts together: buckets by successive digits until singleton or ended."""
    done, open_parts = [], [(list(range(len(texts))), 0, digit)]
    while open_parts:
        members, depth, width = open_parts.pop()
        buckets = defaultdict(list)
        for m in members:
            buckets[texts[m][depth : depth + width]].append(m)
        for value, found in buckets.items():
            if len(found) == 1 or len(value) < width:  # a digit cut short: the texts ended in it
                done.append(found)
            else:
                open_parts.append((found, depth + width, width * WIDENING))
    return done


def _normalised(batches):
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        row, key, text = batch.columns
        body = pc.ascii_lower(pc.fill_null(text, "")).cast(pa.binary())
        sha = pa.array([hashlib.sha256(x).digest() for x in body.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([row, key, sha, pa.array([0] * batch.num_rows, pa.int64()), body], ["row", "id", "sha", "part", "body"])


def _leaves(batches):
    """Rows of a part follow each other; every part is split to its classes as soon as the next one begins."""
    import pyarrow as pa

    names = ["row", "id", "sha", "keep_id", "group_size", "kept"]
    out, part, members, types = {n: [] for n in names}, None, [], None

    def close():
        ids = [columns[1][i].as_py() for columns, i in members]
        rows = [columns[0][i].as_py() for columns, i in members]
        texts = [columns[5][i].as_py() for columns, i in members] if len(members) > 1 else [b""]
        for found in radix_classes(texts):
            stays = max(found, key=lambda m: (ids[m] is not None, ids[m], rows[m]))
            for m in found:
                columns, i = members[m]
                for n, v in zip(names, (rows[m], ids[m], columns[2][i].as_py(), ids[stays], len(found), m == stays), strict=True):
                    out[n].append(v)

    def flushed():
        kinds = [pa.int64(), types, pa.binary(), types, pa.int64(), pa.bool_()]
        made = pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names)
        for n in names:
            out[n].clear()
        return made

    for batch in batches:
        types, columns = batch.columns[1].type, batch.columns
        for i, value in enumerate(zip(columns[3].to_pylist(), columns[4].to_pylist(), strict=True)):
            if value != part and members:
                close()
                members = []
            part = value
            members.append((columns, i))
        if out["row"]:
            yield flushed()
    if members:
        close()
        yield flushed()


def duplicate_classes(numbered: DataFrame, *, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES, first_digit: int = FIRST_DIGIT) -> DataFrame:
    """row, id, sha, keep_id, group_size, kept of every row of ``numbered`` (row: distinct long, id, text).

    Levels are tables in the shared folder; parts of up to ``leaf_rows`` rows and ``leaf_bytes`` bytes are split in a task.
    """
    kind = numbered.schema["id"].dataType.simpleString()
    level = staged(map_batches(numbered.select("row", "id", "text"), _normalised, f"row long, id {kind}, sha binary, part long, body binary"), "radix")
    digit, results = first_digit, []
    while True:
        split = level.withColumn("digit", F.substring("body", 1, digit))
        sizes = split.groupBy("part", "digit").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"), F.max(F.octet_length("body")).alias("longest"), F.max(F.struct("id", "row")).alias("stays"))
        large = (F.col("n") > leaf_rows) | (F.col("n") > 1) & (F.col("bytes") > leaf_bytes)
        found = sizes.where(large).select("part", "digit", "n", "stays", (F.col("longest") <= digit).alias("ended"), F.monotonically_increasing_id().alias("next"))
        found = staged(found, "radix-parts")
        n_large = found.count()
        if n_large:
            placed = split.join(F.broadcast(found) if n_large * (digit + 64) <= BROADCAST_BYTES else found, ["part", "digit"], "left")
        else:
            placed = split.withColumn("next", F.lit(None).cast("long"))
        small = placed.where("next is null").select("row", "id", "sha", "part", "digit", F.expr(f"substring(body, {digit + 1})").alias("rest"))
        small = small.repartition("part", "digit").sortWithinPartitions("part", "digit")
        results.append(map_batches(small, _leaves, f"row long, id {kind}, sha binary, keep_id {kind}, group_size long, kept boolean"))
        if n_large:
            results.append(placed.where("ended").select("row", "id", "sha", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays.row")).alias("kept")))
        if found.where("not ended").isEmpty():
            break
        onward = placed.where("not ended").select("row", "id", "sha", F.col("next").alias("part"), F.expr(f"substring(body, {digit + 1})").alias("body"))
        level = staged(onward, "radix")
        digit *= WIDENING
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The key, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row."""
    classes = duplicate_classes(_numbered(docs, key, text), **bounds)
    return classes.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "radix-docs")
    classes = duplicate_classes(rows.select("row", F.col("doc").getField(key).alias("id"), F.col("doc").getField(text).alias("text")), **bounds)
    return rows.join(classes.where("kept").select("row"), "row", "left_semi").select("doc.*")
