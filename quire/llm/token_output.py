"""Token-ID output: one shared zstandard dictionary, each document compressed alone, an offset index per shard.

A shard file holds the compressed id arrays one after another, then the index (doc id, null flag, offset, bytes,
tokens), then a fixed trailer with the counts and the SHA-256 of the dictionary. Any document is read with one seek.
Rows are range-sorted by doc id, each task writes one shard under a temporary name and renames it when complete, and
the manifest of finished shards is a Parquet table beside them: a lost executor repeats its shard and nothing else.

The dictionary is trained on a bounded sample: about ``DICTIONARY_DOCS`` documents chosen by a hash of id and text, at
most half as many more, and of each at most ``DICTIONARY_PIECE`` bytes of ids, in pieces from all over a longer one. All
documents are encoded and written whole.

Defined results: a null or empty text has the end id alone; null ids sort first; rows that share an id are ordered by
their text and each keeps its own entry; an empty table writes no shard and gives an empty result; only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import filesystem, fresh_path, join_path, map_batches, publish

MAGIC = b"QTOKENS1"
#: Magic, documents, tokens, bytes per id, SHA-256 of the dictionary, start of the index.
TRAILER = "<8sQQQ32sQ"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("n_tokens", "<u8")])
DICTIONARY_DOCS = 1000
DICTIONARY_PIECE = 32 * 1024
DICTIONARY_BYTES = 112 * 1024
#: Pieces that a worker remembers: about 200 bytes each. Fewer take less memory and more time.
CACHE_PIECES = 600_000
SHARD_SCHEMA = "shard int, file string, n_docs long, n_tokens long, bytes long, sha256 string"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def breaks_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizers file is byte-level with the usual pattern, leaves texts as they are and matches no added token over a space."""
    kind = tokenizer.get("pre_tokenizer") or {}
    usual = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    loose = [t for t in tokenizer.get("added_tokens") or () if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])]
    return bool(usual and not tokenizer.get("normalizer") and not loose)


class PieceEncoder:
    """Encodes texts with a tokenizers file, each space-separated piece once while it stays in a bounded cache.

    The byte-level pre-tokenizer always breaks before a single space and around a single line break between visible
    characters, so the ids of such pieces can be joined. Texts with any other white space at a piece's edge are
    encoded as a whole, and so are all texts where the file's tokenizer does not break in that way.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache_pieces = cache_pieces
        self.pieces = breaks_at_spaces(json.loads(self.tokenizer.to_str()))
        self.inner: dict[str, bytes | None] = {}
        self.first: dict[str, bytes | None] = {}
        self.marks = dict(zip(".,\n", self._fresh([*".,\n"]))) if self.pieces else {}

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn_first(self, pieces: Iterable[str]) -> None:
        """Pieces without a space before them: a text's first, or a line's."""
        sound = []
        for p in pieces:
            if p and not p[0].isspace() and not p[-1].isspace():
                sound.append(p)
            else:
                self.first[p] = None
        self.first.update(zip(sound, self._fresh(sound)))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters only, each after a space: many are encoded in one text, where each is one pre-token."""
        width = self.dtype.itemsize
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            e = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            place = np.array(e.word_ids)
            if len(place) and place[-1] + 1 != len(part):  # the file knows another set of letters
                self.inner.update(zip(part, self._fresh([" " + p for p in part])))
                continue
            ends = np.searchsorted(place, np.arange(len(part) + 1)) * width
            ids = np.array(e.ids, self.dtype).tobytes()
            self.inner.update(zip(part, [ids[x:y] for x, y in pairwise(ends.tolist())]))

    def _learn_inner(self, pieces: Iterable[str]) -> None:
        """Pieces after a space or, where they begin with one, a line break.

        A letter and the full stop or comma after it never share a token, so the word is learned alone and the mark is
        added to it.
        """
        inner, words, others, marked, lines = self.inner, set(), set(), [], []
        for p in pieces:
            if p.isalpha():
                words.add(p)
            elif p[:1] == "\n":
                lines.append(p)
            elif not p or p[0].isspace() or p[-1].isspace():
                inner[p] = None
            elif p[-1] in ".," and p[-2:-1].isalpha():
                marked.append(p)
                if p[:-1] not in inner:
                    (words if p[:-1].isalpha() else others).add(p[:-1])
            else:
                others.add(p)
        self._learn_words(list(words))
        new = list(others)
        inner.update(zip(new, self._fresh([" " + p for p in new])))
        for p in marked:
            inner[p] = inner[p[:-1]] + self.marks[p[-1]]
        self._learn_first({p[1:] for p in lines if p[1:] not in self.first})
        for p in lines:
            rest = self.first[p[1:]]
            inner[p] = None if rest is None else self.marks["\n"] + rest

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.pieces:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() if t else b"" for t in texts]
        if len(self.inner) + len(self.first) > self.cache_pieces:
            # Frequent pieces come early, so the older half is worth more than the newer one.
            self.inner = dict(islice(self.inner.items(), len(self.inner) // 2))
            self.first = dict(islice(self.first.items(), len(self.first) // 2))
        split = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        starts = [s.pop(0) if s else None for s in split]
        self._learn_first({p for p in starts if p is not None and p not in self.first})
        found: set[str] = set()
        for s in split:
            found.update(s)
        self._learn_inner(found.difference(self.inner))
        out, ids = [], self.inner.__getitem__
        for t, start, s in zip(texts, starts, split):
            if start is None:
                out.append(b"")
                continue
            try:
                out.append(self.first[start] + b"".join(map(ids, s)))
            except TypeError:  # a piece with white space at its edge
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes())
        return out


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder for each worker process and file; its cache outlives the task.

    Where the driver's path is not on this machine, the installed file of that name is taken.
    """
    if (path, cache_pieces) not in _encoders:
        here = path
        if not os.path.exists(here):
            import public_tokenizers

            here = public_tokenizers.path(os.path.basename(path))
        _encoders[path, cache_pieces] = PieceEncoder(here, cache_pieces)
    return _encoders[path, cache_pieces]


def _batches(rows: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, size):
        yield rows.slice(at, size)


def _spread(ids: bytes) -> bytes:
    """Up to ``DICTIONARY_PIECE`` bytes in four pieces from all over a document's ids."""
    if len(ids) <= DICTIONARY_PIECE:
        return ids
    step, piece = (len(ids) - DICTIONARY_PIECE // 4) // 3 & ~3, DICTIONARY_PIECE // 4
    return b"".join(ids[k * step : k * step + piece] for k in range(4))


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int = 0, cache_pieces: int = CACHE_PIECES) -> bytes:
    """A zstandard dictionary from the bounded sample; empty where there is nothing to learn from."""
    import zstandard

    total = docs.count()
    share = min(1.0, DICTIONARY_DOCS / max(total, 1))
    mark = F.xxhash64("doc_id", "text")
    sample = docs.where(F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(mark.alias("mark"), F.col("text").cast("string").alias("text"))

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, cache_pieces)
        end = np.array([end_id], enc.dtype).tobytes()
        for big in batches:
            for b in _batches(big):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_spread(x + end) for x in enc.encode(b.column(1).to_pylist())], pa.binary())], ["mark", "ids"])

    # Repeated rows share a mark, so the sample's size has a bound of its own.
    rows = map_batches(sample, serialized, "mark long, ids binary").orderBy("mark", "ids").limit(DICTIONARY_DOCS * 3 // 2).collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their bytes are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:] if samples else b""


def _codec(dictionary: bytes):
    """(compressor, decompressor) that share the dictionary."""
    import zstandard

    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    d = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, cache_pieces: int = CACHE_PIECES) -> tuple[DataFrame, bytes]:
    """Writes all rows of ``docs`` in ascending id order under ``out``; the manifest (one row a shard) and the dictionary."""
    dictionary = train_dictionary(docs, tokenizer_path, end_id, cache_pieces)
    store, root = filesystem(out)
    store.create_dir(root, recursive=True)
    digest = hashlib.sha256(dictionary).digest()
    with store.open_output_stream(join_path(root, "dictionary.tmp")) as f:
        f.write(dictionary)
    publish(store, join_path(root, "dictionary.tmp"), join_path(root, f"dictionary-{digest.hex()[:16]}.zdict"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, cache_pieces)
        pack, _ = _codec(dictionary)
        end = np.array([end_id], enc.dtype).tobytes()
        store, root = filesystem(out)
        shard, stream, digest_of, at, tokens, parts = TaskContext.get().partitionId(), None, hashlib.sha256(), 0, 0, []
        name = f"shard-{shard:06d}.qtok"
        temporary = join_path(root, f".{name}.{uuid.uuid4().hex}.tmp")
        try:
            for big in batches:
                for b in _batches(big):
                    if stream is None:
                        stream = store.open_output_stream(temporary)
                    frames = [(x + end) for x in enc.encode(b.column(1).to_pylist())]
                    index = np.zeros(len(frames), INDEX)
                    index["n_tokens"] = [len(x) // enc.dtype.itemsize for x in frames]
                    frames = [pack.compress(x) for x in frames]
                    index["doc_id"] = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                    index["is_null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
                    index["bytes"] = sizes = np.array([len(x) for x in frames], np.int64)
                    index["offset"] = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    tokens += int(index["n_tokens"].sum())
                    parts.append(index)
                    body = b"".join(frames)
                    digest_of.update(body)
                    stream.write(body)
            if stream is None:
                return
            tail = b"".join(p.tobytes() for p in parts)
            n = sum(len(p) for p in parts)
            tail += struct.pack(TRAILER, MAGIC, n, tokens, enc.dtype.itemsize, digest, at)
            digest_of.update(tail)
            stream.write(tail)
            stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
                store.delete_file(temporary)
            raise
        publish(store, temporary, join_path(root, name))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": n, "n_tokens": tokens, "bytes": at + len(tail), "sha256": digest_of.hexdigest()}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = map_batches(rows, write, SHARD_SCHEMA)
    manifest.write.parquet(f"{out}/manifest")
    manifest = docs.sparkSession.read.schema(manifest.schema).parquet(f"{out}/manifest")
    with store.open_output_stream(join_path(root, "format.tmp")) as f:
        f.write(json.dumps({"format": MAGIC.decode(), "dictionary_sha256": digest.hex(), "end_id": end_id}).encode())
    publish(store, join_path(root, "format.tmp"), join_path(root, "format.json"))
    return manifest, dictionary


def _opened(store, path: str, dictionary: bytes):
    """(file, trailer fields, index) of a shard."""
    f = store.open_input_file(path)
    size = f.size()
    f.seek(size - struct.calcsize(TRAILER))
    magic, n, tokens, width, digest, start = struct.unpack(TRAILER, f.read(struct.calcsize(TRAILER)))
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{path} is not a shard of this dictionary")
    f.seek(start)
    return f, (n, tokens, width, start), np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


def read_document(out: str, file: str, row: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document of a shard, by its place in the index."""
    store, root = filesystem(out)
    f, (_, _, width, _), index = _opened(store, join_path(root, file), dictionary)
    with f:
        f.seek(int(index["offset"][row]))
        return np.frombuffer(_codec(dictionary)[1].decompress(f.read(int(index["bytes"][row]))), f"<u{width}").astype("<u4")


def read_shards(manifest: DataFrame, out: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    n = manifest.count()
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    files = manifest.select("file", before.alias("start")).repartition(max(1, n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(out)
        _, unpack = _codec(dictionary)
        for files in batches:
            for file, start in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                f, (n, _, width, end), index = _opened(store, join_path(root, file), dictionary)
                starts = start + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
                with f:
                    for lo in range(0, n, 512):
                        part = index[lo : lo + 512]
                        first, last = int(part["offset"][0]), int(part["offset"][-1]) + int(part["bytes"][-1])
                        f.seek(first)
                        body = f.read(last - first)
                        ids = [np.frombuffer(unpack.decompress(body[o : o + k]), f"<u{width}") for o, k in zip((part["offset"] - first).tolist(), part["bytes"].tolist())]
                        if [len(x) for x in ids] != part["n_tokens"].tolist():
                            raise ValueError(f"{file}: the index does not fit the documents")
                        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"].astype(np.int64), mask=part["is_null"].astype(bool)), pa.array(starts[lo : lo + 512]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(files, read, ROW_SCHEMA)


def token_output(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Writes all of ``docs`` and returns what the files hold."""
    spark: SparkSession = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    manifest, dictionary = write_shards(docs, tokenizer_path, out, end_id, cache_pieces)
    return read_shards(manifest, out, dictionary)
