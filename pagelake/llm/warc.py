"""WARC archives: written by tasks into a shared folder, one gzip member a record, and read back one record at a time.

The folder is a URI that pyarrow can open (file, hdfs, s3, gs), normally below ``spark.checkpoint.dir``. A task writes under a
fresh name and lists it in its result, so after a retry only the files of the winning attempt are read. The reader streams:
it inflates as it reads, frames a payload by Content-Length, wants every record to end with its gzip member, and compares
digests; what breaks a rule is an error that names file and offset. Memory holds one Arrow batch of records (Spark's
``maxRecordsPerBatch`` rows) when writing and one record or 8 MiB of small ones when reading, whatever the archive's size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir, materialise

CHUNK = 1 << 18
MOST_ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT_BYTES = 1000
_DATE = "2000-01-01T00:00:00Z"  # tables carry no time of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SHAPE = "page_id string, record_type string, refers_to string, payload binary, payload_digest string, payload_bytes long, offset long"


class BadRecord(ValueError):
    """An archive that doesn't keep to its own lengths, digests or members."""


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def hex_digest(label: str) -> str:
    """Bare lower-case hex of a ``sha1:`` label in base 32."""
    kind, _, value = label.partition(":")
    if kind != "sha1":
        raise BadRecord(f"digest {label!r}")
    return base64.b32decode(value).hex()


def _header(value: str) -> str:
    """A header value on one line, reversibly: per cent, controls and line ends as %XX."""
    return "".join(c if " " <= c != "%" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _plain(value: str) -> str:
    out, parts = [], value.split("%")
    for i, part in enumerate(parts):
        out.append(part if i == 0 else chr(int(part[:2], 16)) + part[2:])
    return "".join(out)


def format_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisits: bool) -> bytes:
    """One record, not compressed. A revisit carries no payload but the digest and the length of the one it stands for."""
    block = b"" if revisits else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {_header(page_id)}")
    head.append(f"WARC-Payload-Digest: {sha1_label(payload)}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if revisits:
        head.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To: {_header(refers_to)}")
    head += [f"WARC-Block-Digest: {sha1_label(block)}", "Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Counted:
    """A stream that knows how much was read of it; a remote one may not tell."""

    def __init__(self, source: BinaryIO):
        self.source, self.position = source, 0

    def read(self, size: int) -> bytes:
        data = self.source.read(size)
        self.position += len(data)
        return data


class _Member:
    """The inflated bytes of one gzip member, taken from a stream as they are needed."""

    def __init__(self, source: _Counted, ahead: bytes):
        self.source, self.inflate, self.ready, self.waiting = source, zlib.decompressobj(31), bytearray(), ahead

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        raw = self.waiting or self.source.read(CHUNK)
        self.waiting = b""
        if not raw:
            raise BadRecord("the archive ends inside a record")
        try:
            self.ready += self.inflate.decompress(raw, CHUNK)
        except zlib.error as problem:
            raise BadRecord(str(problem)) from problem
        self.waiting = self.inflate.unconsumed_tail
        return True

    def upto(self, mark: bytes) -> bytes:
        since = 0
        while (at := self.ready.find(mark, since)) < 0:
            since = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise BadRecord("no end of the header")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise BadRecord("less than Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def end(self) -> bytes:
        """The raw bytes that follow the member, which must hold nothing more."""
        while not self.inflate.eof:
            self._more()
        if self.ready:
            raise BadRecord("more than one record in a member")
        return self.inflate.unused_data


def read_records(source: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order, each checked before the next is touched."""
    counted = _Counted(source)
    ahead = counted.read(CHUNK)
    while ahead:
        member = _Member(counted, ahead)
        before = counted.position - len(ahead)
        try:
            lines = member.upto(b"\r\n\r\n").decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block = member.exactly(int(fields["Content-Length"]))
            if lines[0] != "WARC/1.1" or member.exactly(4) != b"\r\n\r\n":
                raise BadRecord("not framed as a record")
            ahead = member.end()
            if sha1_label(block) != fields["WARC-Block-Digest"]:
                raise BadRecord("the block's digest differs")
            kind = fields["WARC-Type"]
            if kind == "response" and (fields["WARC-Payload-Digest"] != fields["WARC-Block-Digest"] or int(fields["X-Payload-Length"]) != len(block)):
                raise BadRecord("the payload's digest or length differs")
        except (BadRecord, KeyError, ValueError) as problem:
            raise BadRecord(f"record at byte {before}: {problem}") from problem
        name = fields.get("X-Page-Id")
        refers = fields.get("X-Refers-To")
        yield {
            "page_id": None if name is None else _plain(name), "record_type": kind, "refers_to": None if refers is None else _plain(refers),
            "payload": block if kind == "response" else None, "payload_digest": hex_digest(fields["WARC-Payload-Digest"]), "payload_bytes": int(fields["X-Payload-Length"]), "offset": before,
        }
        if not ahead:
            ahead = counted.read(CHUNK)


def plan_revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rows (id, payload, revisits, refers_to).

    Only digests are grouped, and combined before the shuffle; only those held twice are joined back, so payloads of their
    own never wait for a large group. Of rows with the largest id of an equal payload, all are responses; null ids revisit a
    known one, and are responses where every id is null.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    named = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    held = named.where("digest IS NOT NULL").select("id", "digest").groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("its"), "refers_to")
    # Small payloads have no digest: as null keys of the join they would all meet in one task, so they go past it.
    met = named.where("digest IS NOT NULL").join(held, F.col("digest") == F.col("its"), "left")
    met = met.unionByName(named.where("digest IS NULL"), allowMissingColumns=True)
    revisits = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    return met.select("id", "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("refers_to")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, most_bytes: int = MOST_ARCHIVE_BYTES) -> DataFrame:
    """Writes one archive or more a partition and returns their list: (path, records, bytes). An empty table writes none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, records = None, "", 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(path, compression=None)
                out.write(gzip_member(format_record(row["id"], row["url"], row["payload"], row["refers_to"], row["revisits"])))
                records += 1
                if out.tell() >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    texts = planned.select(F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "payload", "revisits", F.col("refers_to").cast("string").alias("refers_to"))
    return texts.mapInArrow(run, "name string, records long, bytes long")


def read_archives(listed: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives, each archive streamed by one task. Without ``payloads`` they are checked and dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch["name"].to_pylist(), batch["records"].to_pylist()):
                found, rows, size = 0, [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for record in read_records(source):
                        found += 1
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        size += len(record["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                if found != expected:
                    raise BadRecord(f"{name}: {found} records, {expected} were written")
                if rows:
                    yield _records(rows)

    return listed.mapInArrow(run, RECORD_SHAPE)


def _records(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "offset": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]], list(rows[0]))


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, as a URI."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", payloads: bool = False, partitions: int | None = None) -> DataFrame:
    """Write all pages to archives and read them back: rows (page_id, record_type, refers_to, payload, payload_digest, ...).

    A null html is an empty payload, a null id comes back as null, repeated rows are records of their own, an empty table
    gives no rows; a payload of any length is one record. Of further columns only ``url`` is written, whatever their names.
    Ids come back in their own type.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    folder = archive_folder(spark)
    listed = materialise(write_archives(plan_revisits(pages, id_col, html_col), folder), "warc-list")
    # The list is small; dealt out, so that archives are read by as many tasks as there are files.
    read = read_archives(listed.repartition(partitions or max(1, min(listed.count(), 10_000))), folder, payloads)
    return read.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
