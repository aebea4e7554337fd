"""Named text files in a folder that every executor reaches: written under a temporary name and renamed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shipping import map_batches


def opened(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def write_texts(rows: DataFrame, folder: str) -> int:
    """Writes (name, text) rows as files from the executors; how many."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        n = 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary, compression=None) as f:
                    f.write((text or "").encode())
                store.move(temporary, f"{root}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return map_batches(rows.select("name", "text"), write, "n long").agg(F.sum("n")).first()[0] or 0


def delete_files(folder: str, names: list[str]) -> int:
    """Deletes named files; those that are not there are not counted."""
    from pyarrow import fs

    store, root = opened(folder)
    n = 0
    for name in names:
        if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            store.delete_file(f"{root}/{name}")
            n += 1
    return n
