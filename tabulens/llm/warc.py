"""WARC archives without repeated payloads: revisit records, written and resolved again.

Only headers are shuffled by payload digest. The smallest page of a digest keeps the payload in a
response record; the others become revisit records that name it. Reading resolves revisits by a
join on record ids.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import filesystem, new_folder, put_file, settled

MIN_REVISIT_BYTES = 0
FILE_BYTES = 32 << 20  # compressed bytes after which a file is closed
MAX_TASKS = 10_000  # of a read; a task may read several files
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, record_id string, record_type string, payload_bytes bigint, payload_digest string, target_uri string, refers_to_record string"


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _clean(uri: str | None) -> str:
    """A URI on one header line: controls, spaces and non-ASCII percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (uri or "").encode()).decode("ascii")


def record_bytes(page_id, uri, payload: bytes | None, n_payload, digest, original_id, original_uri, date) -> bytes:
    """One record in a gzip member of its own; ``original_id`` marks a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_payload
    revisit = original_id is not None
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Page-ID", str(page_id)),
    ]
    if revisit:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(original_id, digest)),
            ("WARC-Refers-To-Target-URI", _clean(original_uri)),
            ("WARC-Refers-To-Date", date),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, gzip member by member: headers in lower case, and the block."""
    rest = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        while not unzip.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise EOFError("the file ends within a record")
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        data = io.BytesIO(b"".join(parts))
        if not data.readline().startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = {}
        while (line := data.readline().strip()):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, data.read(int(head["content-length"]))


def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, sha, original_id, original_uri) from headers (page_id, sha, n, url); original_id NULL: response."""
    first = pages.groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"))
    again = (F.col("first.page_id") != F.col("page_id")) & (F.col("n") >= min_bytes)
    return pages.join(first, "sha").select(
        "page_id", "sha",
        F.when(again, F.col("first.page_id")).alias("original_id"),
        F.when(again, F.col("first.url")).alias("original_uri"),
    ).distinct()


def write_archives(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
    folder: str | None = None,
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write .warc.gz files; the manifest (path, n_records).

    Of rows with equal payloads of at least ``min_bytes``, the one with the smallest id is the
    response; rows that repeat that id and payload are responses too. NULL payloads are empty.
    """
    folder = folder or new_folder(df.sparkSession, "warc")
    key = df[f"`{id_col}`"]
    pages = df.where(key.isNotNull()).select(
        key.cast("bigint").alias("page_id"), df[f"`{url_col}`"].alias("url"),
        F.encode(F.coalesce(df[f"`{payload_col}`"], F.lit("")), "UTF-8").alias("payload"),
    )
    pages = pages.select("*", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("bigint").alias("n"))
    role = roles(pages.select("page_id", "sha", "n", "url"), min_bytes)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, parts = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush():
            path = put_file(folder, f"part-{part:06d}-{seq:05d}.warc.gz", b"".join(parts))
            return pd.DataFrame({"path": [path], "n_records": [len(parts)]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                original = int(row.original_id) if row.original_id is not None else None
                digest = base64.b32encode(row.sha).decode()
                parts.append(record_bytes(row.page_id, row.url, row.payload, row.n, digest, original, row.original_uri, date))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield flush()
                    parts, size, seq = [], 0, seq + 1
        if parts:
            yield flush()

    joined = pages.join(role, ["page_id", "sha"]).select(
        "page_id", "url", "sha", "n", F.col("original_id").cast("string").alias("original_id"), "original_uri",
        F.when(F.col("original_id").isNull(), F.col("payload")).alias("payload"),
    )
    return settled(joined.mapInPandas(write, "path string, n_records bigint"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the files: see RECORD. A payload that misses its digest raises."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                system, at = filesystem(path)
                rows = []
                with system.open_input_stream(at, compression=None) as f:
                    for head, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        n = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                        if head["warc-type"] == "response" and (n != len(payload) or base32_sha1(payload) != digest):
                            raise ValueError(f"{path}: payload of {head['warc-record-id']} is damaged")
                        rows.append((int(head["warc-page-id"]), head["warc-record-id"], head["warc-type"], n, digest,
                                     head["warc-target-uri"], head.get("warc-refers-to")))
                yield pd.DataFrame(rows, columns=names)

    return manifest.select("path").repartition(min(MAX_TASKS, max(1, manifest.count()))).mapInPandas(read, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Join revisit records to their original responses: adds ``refers_to``, NULL for responses.

    A revisit whose original is in no archive has a NULL ``refers_to``.
    """
    originals = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    ).distinct()
    return found.join(originals, "refers_to_record", "left").drop("refers_to_record")
