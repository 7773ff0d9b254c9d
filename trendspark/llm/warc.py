"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader inflates one member at a time in bounded steps, frames the block by its Content-Length
and checks block and payload digests. Archives lie in a folder that all executors reach; every task
attempt writes files of its own, and only the manifest that Spark commits says which of them count,
so a lost executor or a repeated task leaves no wrong record.

Defined results: a null payload is empty; a record without id has the id ``urn:page:null``; of
several rows with the largest id of a payload all are responses; an empty table gives no archive.
A url of any length is kept whole; headers are held in memory until their end, or the member's.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.session import materialize, shared_folder

ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = (
    "record_id string, target_uri string, record_type string, refers_to string, payload_bytes bigint, "
    "payload_digest string, payload binary, path string"
)
STEP = 1 << 16


def with_roles(
    pages: DataFrame, key: str = "page_id", text: str = "html", least: int = 1000
) -> DataFrame:
    """Adds ``payload``, ``digest``, ``record_type`` and ``refers_to``.

    Counts are aggregated before the shuffle; the join on the digest has one row per digest on its
    right side, and a hot payload on the left is split at run time.
    """
    staged = pages.withColumn("payload", F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    staged = staged.withColumn("digest", F.sha1("payload"))
    first = (
        staged.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max(key).alias("_first"))
    )
    is_revisit = F.col(key) < F.col("_first")
    return (
        staged.join(first, "digest", "left")
        .withColumn("record_type", F.when(is_revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(is_revisit, F.col("_first")))
        .drop("_first")
    )


def _header(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(
    record_id: str, uri: str | None, kind: str, refers_to: str | None, payload: bytes
) -> bytes:
    """One WARC record, uncompressed; a revisit keeps the HTTP head and leaves the payload out."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_header(record_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_header(refers_to or '')}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = 1 << 28, level: int = 6
) -> DataFrame:
    """Writes ``record_id, target_uri, record_type, refers_to, payload``; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out = path = None
        done: list[tuple[str, int, int]] = []
        count = size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    path = f"{folder}/{name}"
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                plain = record_bytes(
                    row["record_id"], row["target_uri"], row["record_type"], row["refers_to"], row["payload"]
                )
                member = packer.compress(plain) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_pylist(
                [{"path": p, "records": n, "bytes": b} for p, n, b in done]
            )

    wanted = records.select("record_id", "target_uri", "record_type", "refers_to", "payload")
    return materialize(wanted.mapInArrow(write, MANIFEST))


class Members:
    """Plain bytes of a gzip stream, member by member."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.ready = stream, b"", b""
        self.inflater = None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(STEP)
        if not self.raw:
            return False
        self.inflater, self.ready = zlib.decompressobj(31), b""
        return True

    def _more(self) -> bool:
        """Inflates at most one step."""
        while not self.inflater.eof:
            source = self.inflater.unconsumed_tail or self.raw or self.stream.read(STEP)
            if not self.inflater.unconsumed_tail:
                self.raw = b""
            if not source:
                raise ValueError("the archive ends inside a member")
            piece = self.inflater.decompress(source, STEP)
            if self.inflater.eof:
                self.raw = self.inflater.unused_data
            if piece:
                self.ready += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen, start = bytearray(self.ready), 0
        while (at := seen.find(mark, start)) < 0:
            start, self.ready = max(0, len(seen) - len(mark) + 1), b""
            if not self._more():
                raise ValueError("no end of headers")
            seen += self.ready
        self.ready = bytes(seen[at + len(mark):])
        return bytes(seen[:at])

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self._more():
                raise ValueError("the record is shorter than its Content-Length")
            piece, self.ready = self.ready[:size], self.ready[size:]
            size -= len(piece)
            yield piece

    def finish(self) -> None:
        while self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise ValueError("the record is longer than its Content-Length")


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """Records of one archive in order; raises on broken framing or a wrong digest."""
    members = Members(stream)
    while members.next_member():
        warc = _headers(members.until(b"\r\n\r\n"))
        http_size, block_hash, payload_hash = None, hashlib.sha1(), hashlib.sha1()
        head, parts = b"", []
        for piece in members.take(int(warc["content-length"])):
            block_hash.update(piece)
            if http_size is None:
                head += piece
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http_size = int(_headers(head[:at])["content-length"])
                piece = head[at + 4:]
            payload_hash.update(piece)
            if with_payload:
                parts.append(piece)
        members.finish()
        if block_hash.hexdigest() != _hex(warc["warc-block-digest"]):
            raise ValueError(f"wrong block digest: {warc['warc-record-id']}")
        digest = _hex(warc["warc-payload-digest"])
        if warc["warc-type"] == "response" and payload_hash.hexdigest() != digest:
            raise ValueError(f"wrong payload digest: {warc['warc-record-id']}")
        refers = warc.get("warc-refers-to")
        yield {
            "record_id": warc["warc-record-id"][1:-1],
            "target_uri": warc.get("warc-target-uri"),
            "record_type": warc["warc-type"],
            "refers_to": refers[1:-1] if refers else None,
            "payload_bytes": http_size,
            "payload_digest": digest,
            "payload": b"".join(parts) if with_payload and warc["warc-type"] == "response" else None,
        }


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 1 << 24) -> DataFrame:
    """All records of the manifest's archives, one archive after another in each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                *((n, pa.string()) for n in ("record_id", "target_uri", "record_type", "refers_to")),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("payload", pa.binary()),
                ("path", pa.string()),
            ]
        )
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as stream:
                    for record in read_records(stream, with_payload):
                        rows.append({**record, "path": path})
                        size += len(record["payload"] or b"") + len(record["target_uri"] or "") + 500
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    many = max(1, manifest.count())
    return manifest.select("path").repartition(many).mapInArrow(read, RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) for :func:`write_archives`."""
    roles = with_roles(pages.select("page_id", "url", "html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return roles.select(
        F.concat(F.lit(ID), page).alias("record_id"),
        F.col("url").alias("target_uri"),
        "record_type",
        F.concat(F.lit(ID), F.col("refers_to").cast("string")).alias("refers_to"),
        "payload",
    )


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
