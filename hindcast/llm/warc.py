"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The writer gives each task's records to files of about FILE_BYTES in a shared folder, each written
under a name of its own and listed only by the attempt that succeeded, so retried or duplicated
tasks leave files that nobody reads. The reader takes one listed file per row and goes through it
front to back: a fresh decompressor for each member, headers up to the blank line, then exactly
Content-Length bytes of block, whose digests are computed on the way and compared. It never holds
more than a chunk of a payload.

A NULL payload is written as an empty one. Of the records with equal payloads, the one with the
largest id is the response and the others are revisits that refer to it and carry no payload.
Repeated rows of that largest id are responses all. Rows with NULL ids are revisits of the largest
id, or responses if there is none. Folders are any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import cut_lineage, ensure_checkpoint_dir

VERSION = b"WARC/1.1"
FILE_BYTES = 256 << 20
CHUNK = 1 << 16
MOST_HEADER_BYTES = 1 << 20

# Fixed value of the standard for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


class WarcError(ValueError):
    """An archive that is cut off, misframed, or whose digest differs."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def spark_digest(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1, by built-in functions: 5 hex digits are 4 characters."""
    hexed = F.sha1(payload)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        parts += [
            F.substr(letters, F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1))
            for shift in (15, 10, 5, 0)
        ]
    return F.concat(*parts)


# One record

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member; `refers_to` makes it a revisit."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    # Header values hold no line breaks; other characters stay as they are.
    target = "".join(c if c not in "\r\n" else "%0A" for c in (url or ""))
    name = page_id if page_id is not None else uuid.uuid4()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


# The sequential reader

@dataclass
class Head:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "").strip("<>").removeprefix(_ID)
        return int(value) if value.lstrip("-").isdigit() else None


class _Member:
    """The decompressed bytes of one gzip member, as a stream of chunks."""

    def __init__(self, source, start: bytes):
        self.source, self.packed = source, start
        self.inflate = zlib.decompressobj(31)
        self.plain = b""

    def fill(self) -> bool:
        """More plain bytes, or False at the end of the member."""
        while not self.inflate.eof:
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                if not self.packed:
                    raise WarcError("the archive ends inside a record")
            try:
                got = self.inflate.decompress(self.packed, CHUNK)
            except zlib.error as error:
                raise WarcError(f"a member is not gzip: {error}") from error
            self.packed = self.inflate.unconsumed_tail or self.inflate.unused_data
            if got:
                self.plain += got
                return True
        return False

    def until_blank_line(self) -> bytes:
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if len(self.plain) > MOST_HEADER_BYTES or not self.fill():
                raise WarcError("no blank line ends the header")
        head, self.plain = self.plain[:at], self.plain[at + 4 :]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.plain and not self.fill():
                raise WarcError("a record is shorter than its Content-Length")
            part, self.plain = self.plain[:size], self.plain[size:]
            size -= len(part)
            yield part


def _fields(lines: list[bytes]) -> dict[str, str]:
    parts = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in parts}


def read_records(source) -> Iterator[Head]:
    """All records of an open archive, in order, each checked against its lengths and digests."""
    packed = source.read(CHUNK)
    while packed:
        member = _Member(source, packed)
        version, *lines = member.until_blank_line().split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise WarcError("a record doesn't start with its version")
        headers = _fields(lines)
        length = int(headers["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        head, http, seen = b"", None, 0
        for part in member.take(length):
            block.update(part)
            if http is None:
                head += part
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, part = _fields(head[:at].split(b"\r\n")[1:]), head[at + 4 :]
            payload.update(part)
            seen += len(part)
        rest = b"".join(member.take(4))
        if rest != b"\r\n\r\n" or member.plain or member.fill():
            raise WarcError("a record is longer than its Content-Length")
        if f"sha1:{base32_sha1(block.digest())}" != headers["warc-block-digest"]:
            raise WarcError("a block differs from its digest")
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        size = int((http or {}).get("content-length", 0))
        if headers["warc-type"] == "response" and (
            seen != size or base32_sha1(payload.digest()) != digest
        ):
            raise WarcError("a payload differs from its digest")
        yield Head(headers, http or {}, size, digest)
        packed = member.packed or source.read(CHUNK)


# Spark

def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url",
                   payload: str = "html") -> DataFrame:
    """Writes one record per row below `folder`; returns the stored list (path, records, bytes).

    Payloads move once, to the largest id of their digest; the other side of that join holds one
    narrow row per distinct payload.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("body"), spark_digest(body).alias("digest")
    )
    latest = rows.groupBy("digest").agg(F.max("page_id").alias("latest"))
    revisit = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id"))
    marked = rows.join(latest, "digest").withColumn("refers_to", F.when(revisit, F.col("latest"))).drop("latest")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, records, size, listed = None, None, 0, 0, []
        for batch in batches:
            for page_id, target, body, digest, refers_to in batch[
                ["page_id", "url", "body", "digest", "refers_to"]
            ].itertuples(index=False):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                data = record(
                    None if pd.isna(page_id) else int(page_id), target, body, digest,
                    None if pd.isna(refers_to) else int(refers_to),
                )
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    listed.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            listed.append((path, records, size))
        yield pd.DataFrame(listed, columns=["path", "records", "bytes"])

    ordered = marked.select("page_id", "url", "body", "digest", "refers_to")
    return cut_lineage(ordered.mapInPandas(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_stream(path, compression=None) as source:
                    rows = []
                    for head in read_records(source):
                        rows.append((
                            head.page("warc-record-id"), head.headers.get("warc-target-uri"),
                            head.payload_bytes, head.payload_digest, head.headers["warc-type"],
                            head.page("warc-refers-to"),
                        ))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    files = max(1, archives.count())
    return archives.repartition(files).mapInPandas(
        read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long",
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
