"""WARC archives: range-sorted records, files rolled by compressed size, regenerated headers, manifest commit.

Equal payloads of at least ``min_revisit_bytes`` are stored once: the row with the largest page id is the response
and the others are revisit records that refer to it. Each record is a gzip member of its own. A task writes its files
under temporary names and renames them when complete; the manifest of finished files is a Parquet table beside them,
and readers open only what it lists. Dates are a parameter and record ids are derived from the content, so a repeated
run gives the same bytes.

Defined results: a null payload is empty and a null URL gets a ``urn:`` target; null page ids sort first; of repeated
rows with the largest id the first is the response and the others revisit it; an empty table writes no file and gives
an empty result; only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import filesystem, fresh_path, join_path, map_batches, publish, staged

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
#: Lists of repeated payloads of up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_PAYLOADS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quire:warc")
FILE_SCHEMA = "part int, sequence int, file string, n_records long, bytes long, sha256 string"
ROW_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _target(url: str | None, page: int | None) -> str:
    """A header-safe target URI."""
    if not url:
        return f"urn:x-page:{page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page: int | None, digest: str, place: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}|{digest}|{place}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: int = 0, date: str = DATE) -> bytes:
    """The bytes of one record before compression; ``place`` numbers equal rows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = lambda hexed: base64.b32encode(bytes.fromhex(hexed)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url, page)}",
        f"WARC-Payload-Digest: sha1:{b32(digest)}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest and original: the largest page id with the same payload, where rows share one."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    shared = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1 and original is not null").select("digest", "original")
    shared = staged(shared, "warc-payloads")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared
    return rows.join(side, "digest", "left").select("page_id", "url", "html", "digest", "original")


def write_archives(pages: DataFrame, out: str, *, roll_bytes: int = ROLL_BYTES, min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes every row of ``pages`` under ``out``; the manifest, one row a file."""
    store, root = filesystem(out)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(out)
        part, done, now = TaskContext.get().partitionId(), [], None
        last, place = None, 0

        def close() -> None:
            now["stream"].close()
            publish(store, now["temporary"], join_path(root, now["file"]))
            done.append({"part": part, "sequence": len(done), "file": now["file"], "n_records": now["n"], "bytes": now["bytes"], "sha256": now["sha"].hexdigest()})

        try:
            for b in batches:
                for page, url, html, digest, original in zip(*[c.to_pylist() for c in b.columns]):
                    # Equal rows stand together; only the first of those with the largest id is the response.
                    place = place + 1 if (page, digest) == last else 0
                    last = (page, digest)
                    refers = original if original is not None and (page != original or place) else None
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, (html or "").encode(), digest, refers, place, date)) + packer.flush()
                    if now and now["bytes"] + len(member) > roll_bytes:
                        close()
                        now = None
                    if now is None:
                        name = f"part-{part:06d}-{len(done):05d}.warc.gz"
                        temporary = join_path(root, f".{name}.{uuid.uuid4().hex}.tmp")
                        now = {"file": name, "temporary": temporary, "stream": store.open_output_stream(temporary), "n": 0, "bytes": 0, "sha": hashlib.sha256()}
                    now["stream"].write(member)
                    now["sha"].update(member)
                    now["n"] += 1
                    now["bytes"] += len(member)
            if now:
                close()
                now = None
        finally:
            if now:
                now["stream"].close()
                store.delete_file(now["temporary"])
        yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int32()), ("sequence", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    rows = with_originals(pages, min_bytes)
    rows = rows.repartitionByRange(F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "url")
    manifest = map_batches(rows, write, FILE_SCHEMA)
    manifest.write.parquet(f"{out}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{out}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    data, unpack, parts = stream.read(chunk), zlib.decompressobj(31), []
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or stream.read(chunk)
    if parts:
        raise ValueError("the last record is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"]:
        raise ValueError(f"{headers['WARC-Record-ID']}: the block does not fit its digest")
    return headers, block


def read_archives(manifest: DataFrame, out: str) -> DataFrame:
    """The digest of the contract for every record of the listed files."""
    files = manifest.select("file", "n_records").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(out)
        types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for file, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen = [], 0
                with store.open_input_stream(join_path(root, file), compression=None) as stream:
                    for raw in members(stream):
                        headers, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{file}: a payload does not fit its headers")
                        rows.append({"page_id": number(headers.get("X-Page-ID")), "payload_bytes": length, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": number(headers.get("X-Refers-To-Page-ID"))})
                        seen += 1
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                if seen != n:
                    raise ValueError(f"{file}: {seen} records, {n} expected")
                yield pa.RecordBatch.from_pylist(rows, types)

    return map_batches(files, read, ROW_SCHEMA)


def warc_round_trip(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Writes all of ``pages`` and returns what the archives hold."""
    out = out or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, out, **options), out)
