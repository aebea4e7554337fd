"""Shared storage and small column helpers for the training-data operators."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shipping import map_batches, ship_package  # noqa: F401  the operators take them from here
from quire.sources.storage import forget, fresh_path, shared_root, staged  # noqa: F401

#: Word separators of every contract: space and the ASCII controls tab to carriage return.
WORD_BREAK = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sized(rows: int, rows_per_part: int = 500_000, least: int = 8) -> int:
    """Partitions for a table of so many short rows; it grows with them."""
    return max(least, -(-rows // rows_per_part))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder's URI; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def publish(store, temporary: str, final: str) -> None:
    """Moves a finished file to its name; a second attempt that lost the race only cleans up its own copy."""
    from pyarrow import fs

    try:
        store.move(temporary, final)
    except OSError:
        if store.get_file_info(final).type != fs.FileType.File:
            raise
        store.delete_file(temporary)


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int):
    """The batches in pieces of up to so many rows, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
