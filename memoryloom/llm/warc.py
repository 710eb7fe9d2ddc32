"""WARC archives: a writer of one gzip member per record and a sequential, digest-checking reader."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, new_path, stage, tidy

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Payloads from this size on are stored once; later equal ones become revisit records.
REVISIT_BYTES = 1000
CHUNK = 1 << 16
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member with a response record, or a revisit record (no payload) if refers_to is given."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", _sha1_label(payload)),
        ("WARC-Block-Digest", _sha1_label(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def members(read) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time; read(n) gives at most n bytes, none at the end."""
    data = read(CHUNK)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends inside a gzip member")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else read(CHUNK)
        yield b"".join(parts)
        data = data or read(CHUNK)


def decode_record(raw: bytes) -> dict:
    """Frame a record by its content length, and verify its block digest and (responses) its payload digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the content length doesn't frame the record")
    block = rest[:n]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    kind, label = fields["warc-type"], fields["warc-payload-digest"]
    ok = fields["warc-block-digest"] == _sha1_label(block) and (kind == "revisit" or (label == _sha1_label(payload) and length == len(payload)))
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": length, "payload_digest": base64.b32decode(label[5:]).hex(), "record_type": kind,
        "refers_to": number("x-refers-to-page-id"), "digest_ok": ok, "url": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload,
    }


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt, n, done, sink, records, size = task.partitionId(), task.taskAttemptId(), 0, [], None, 0, 0
        name = temporary = ""

        def close():
            sink.close()
            files.move(temporary, name)  # an archive appears whole, or not at all
            done.append((posixpath.basename(name), records, size))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*cols, strict=True):
                if sink is None:
                    name, records, size = posixpath.join(root, f"part-{part:06d}-{n:05d}.warc.gz"), 0, 0
                    temporary = f"{name}.{attempt}.tmp"
                    sink, n = files.open_output_stream(temporary, compression=None), n + 1
                data = encode_record(page_id, url, payload, refers_to)
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row to archives in folder (a URI that all executors share); returns one row an archive.

    Equal payloads of at least revisit_bytes are stored once, by the row with the largest key; the others revisit it.
    Null html is an empty payload, null urls are empty, repeated rows with the largest key are each a response, and
    rows without a key whose group has none are responses. A lost task writes its archives again under the same names.
    Only the three columns are read, whatever the others are called; an empty table writes no record; a payload of any
    length is one record and must fit into a row.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_n"))
    kept = rows.filter(F.col("_n") >= revisit_bytes).groupBy("_sha1", "_n").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_copies"))
    kept = stage(kept.filter("_copies > 1 and _kept is not null").drop("_copies"), "warc-kept")  # its size is known from here on
    typed = rows.join(kept, ["_sha1", "_n"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_kept")), F.col("_kept")).alias("refers_to"))
    manifest = stage(typed.mapInArrow(tidy(_writer(folder)), "archive string, records long, bytes long"), "warc-manifest")
    drop(kept)
    return manifest


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out, seen = [], 0
                with files.open_input_stream(posixpath.join(root, name), compression=None) as source:
                    for raw in members(source.read):
                        out.append(decode_record(raw))
                        seen += 1
                        out[-1].pop("payload"), out[-1].pop("url")
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                if seen != expected:
                    raise ValueError(f"{name} has {seen} of {expected} records")
                yield pa.RecordBatch.from_pylist(out, schema)

    return read


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Read archives back, each sequentially in bounded memory: a row for each record, with digest_ok.

    Framing errors, cut archives and missing records raise; a wrong digest gives digest_ok false.
    """
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(tidy(_reader(folder)), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back; a wrong digest stops the job. Cases as in write_warc;
    an empty table gives an empty one."""
    folder = new_path(pages.sparkSession, "warc")
    records = read_warc(write_warc(pages, folder), folder)
    bad = F.raise_error(F.concat(F.lit("wrong digest in page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return records.withColumn("record_type", F.when(F.col("digest_ok"), F.col("record_type")).otherwise(bad))
