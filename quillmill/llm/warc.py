"""WARC archives as tables of chunks: written and read without a whole record in memory.

A payload is cut into chunks of ``CHUNK`` bytes by column functions, rows (record, chunk number); the
``warc`` sink streams such rows into archives, one gzip member a record, and the source streams archives
back into such rows, each with the digest of the payload up to and with it. A record's rows stay together
and in order, as neither side shuffles them. Memory holds a few chunks, at any size of record.

A sink's task writes files of its own name and hands the names over when it ends; the driver then writes
the list ``_archives``, and only files on it are read. A lost or repeated task leaves files that nothing reads.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillmill.llm.joins import with_counts
from quillmill.storage import shared_dir, written

CHUNK = 256 << 10
#: A file is closed after the record with which it reaches this size.
ARCHIVE_BYTES = 1 << 30
#: Shorter payloads are stored again rather than referred to.
LEAST_REVISIT = 1000
#: Groups of equal payloads up to which their table, of about 50 bytes a row, is broadcast.
BROADCAST_GROUPS = 500_000
LIST = "_archives"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"
#: What the sink takes; data is null for records without a payload.
SINK = "record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, chunk_no int, data binary"
SOURCE = SINK + ", position long, running_digest string, is_last boolean"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)
    return fs, at.rstrip("/")


def _value(text: str) -> str:
    """A header's value: without line ends and other controls."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), text)


def _head(r: dict) -> bytes:
    """The header of a record and, for a response, the HTTP header that its block starts with."""
    response = r["record_type"] == "response"
    fields = [
        ("WARC-Type", r["record_type"]),
        ("WARC-Record-ID", f"<{URN}{_value(r['record_id'] or '')}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _value(r["target_uri"]))] if r["target_uri"] is not None else []),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
        ("X-Payload-Length", str(r["payload_bytes"])),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{URN}{_value(r['refers_to'])}>")] if r["record_type"] == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(HTTP) + (r["payload_bytes"] if response else 0))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + HTTP


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Archives:
    """Files of one task: a record is one gzip member."""

    def __init__(self, path: str, most: int) -> None:
        self.fs, self.root = _filesystem(path)
        self.fs.create_dir(self.root, recursive=True)
        self.most, self.files, self.out, self.gzip = most, [], None, None

    def start(self, head: bytes) -> None:
        if self.out is None:
            self.files.append(f"{uuid.uuid4().hex}.warc.gz")
            self.out = self.fs.open_output_stream(f"{self.root}/{self.files[-1]}", compression=None)
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(head)

    def put(self, data: bytes) -> None:
        self.out.write(self.gzip.compress(data))

    def end(self) -> None:
        if self.gzip is not None:
            self.out.write(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
            self.gzip = None
            if self.out.tell() >= self.most:
                self.close()

    def close(self) -> None:
        self.end()
        if self.out is not None:
            self.out.close()
            self.out = None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        to = _Archives(self.path, self.most)
        left = 0
        for batch in iterator:
            columns = [batch.column(n) for n in ("record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest")]
            for i, (no, data) in enumerate(zip(batch.column("chunk_no").to_pylist(), batch.column("data"), strict=True)):
                if no == 0:
                    if left:
                        raise ValueError("a record ended before its payload")
                    to.end()
                    r = dict(zip(("record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest"), (c[i].as_py() for c in columns), strict=True))
                    to.start(_head(r))
                    left = r["payload_bytes"] if r["record_type"] == "response" else 0
                if data.is_valid:
                    buffer = data.as_buffer()
                    to.put(buffer)
                    left -= buffer.size
        if left:
            raise ValueError("a record ended before its payload")
        to.close()
        return Written(to.files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LIST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


class _Stream:
    """Bytes of an archive, plain or of gzip members one after another, by lines and by pieces."""

    def __init__(self, source, piece: int) -> None:
        self.source, self.piece, self.held, self.gzip, self.raw = source, piece, b"", None, b""
        self.raw = source.read(piece)
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bytes:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    return b""
            if not self.packed:
                out, self.raw = self.raw, b""
                return out
            if self.gzip is None:
                self.gzip = zlib.decompressobj(31)
            out = self.gzip.decompress(self.raw, self.piece)
            self.raw = self.gzip.unconsumed_tail or self.gzip.unused_data
            if self.gzip.eof:
                self.gzip = None
            if out:
                return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        at = 0
        while (found := self.held.find(b"\n", at)) < 0:
            more, at = self._more(), len(self.held)
            if not more:
                out, self.held = self.held, b""
                return out or None
            self.held += more
        out, self.held = self.held[:found], self.held[found + 1 :]
        return out.rstrip(b"\r")

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of ``piece`` bytes, the last one shorter."""
        while n:
            want = min(n, self.piece)
            parts, size = [self.held], len(self.held)
            while size < want:
                more = self._more()
                if not more:
                    raise ValueError("an archive ends within a record")
                parts.append(more)
                size += len(more)
            whole = b"".join(parts)
            out, self.held = whole[:want], whole[want:]
            n -= want
            yield out


def _records(stream: _Stream) -> Iterator[tuple[dict[str, str], int]]:
    """Header fields, names in lower case, and length of each record; the caller takes the block."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, int(fields["content-length"])


def _named(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<").removesuffix(">").removeprefix(URN)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunkBytes", CHUNK))
        self.with_data = options.get("data", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, root = _filesystem(self.path)
        kind = pafs.FileType
        if fs.get_file_info(f"{root}/{LIST}").type == kind.File:
            with fs.open_input_stream(f"{root}/{LIST}") as source:
                names = [f"{root}/{n}" for n in json.loads(source.read())]
        elif fs.get_file_info(root).type == kind.File:
            names = [root]
        else:
            names = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith((".warc", ".warc.gz"))]
        return [InputPartition(n) for n in names or [None]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # no archives
            return
        fs, _ = _filesystem(self.path)
        schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("position", pa.int64()), ("running_digest", pa.string()), ("is_last", pa.bool_())])
        rows, held = [], 0
        with fs.open_input_stream(partition.value, compression=None) as source:
            stream = _Stream(source, self.chunk)
            for fields, length in _records(stream):
                for row in self._chunks(stream, fields, length):
                    rows.append(row)
                    held += 400 + len(row["data"] or b"")
                    if held > 16 * self.chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _chunks(self, stream: _Stream, fields: dict[str, str], length: int) -> Iterator[dict]:
        kind = fields.get("warc-type", "")
        base = {"record_id": _named(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _named(fields.get("warc-refers-to"))}
        stated = fields.get("x-payload-length")
        base["payload_digest"] = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if fields.get("content-type", "").startswith("application/http"):
            taken = 0
            while taken < length:
                line = stream.line()
                taken += len(line or b"") + 2
                if not line:
                    break
            length -= taken
        digest, at, no = hashlib.sha1(), 0, 0
        base["payload_bytes"] = length if stated is None else int(stated)
        # a record without a payload still has a row
        for data in stream.pieces(length) if length else [b""]:
            digest.update(data)
            at += len(data)
            yield base | {"chunk_no": no, "data": data if self.with_data else None, "position": at, "running_digest": digest.hexdigest(), "is_last": at == length}
            no += 1


class WarcSource(DataSource):
    """Format ``warc``: options path, archiveBytes (sink), chunkBytes and data (source; data=false leaves payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def with_types(rows: DataFrame, payload: Column, *, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` (record_id, target_uri, and what ``payload`` needs) with payload, payload_bytes, payload_digest, record_type, refers_to.

    Of rows whose payloads of ``LEAST_REVISIT`` bytes or more are equal, those with the largest record_id
    are responses and the others revisit it. The table of groups holds digests only. It is broadcast up to
    ``broadcast_groups`` rows; beyond that, payloads move to the groups, common ones excepted.
    """
    binary = F.coalesce(payload, F.lit("")).cast("binary")
    whole = rows.select("record_id", "target_uri", binary.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    keys = whole.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.max("record_id").alias("head"), F.count("*").alias("n"))
    groups = written(keys.filter("n > 1 AND head IS NOT NULL"), "warc-groups")
    size = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if size["groups"] <= broadcast_groups:
        named = F.broadcast(groups.select("payload_digest", "payload_bytes", "head"))  # counted above
        found = whole.join(named, ["payload_digest", "payload_bytes"], "left")
    else:
        total = max(size["n"], whole.count())
        found = with_counts(whole, groups, {"payload_digest": "payload_digest", "payload_bytes": "payload_bytes"}, {"head": "head"}, "n", total)
    again = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("record_id"))
    return found.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("head"))}).drop("head")


def chunk_rows(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of the sink: a response's payload in chunks, a row without data for a revisit or an empty payload."""
    response = F.col("record_type") == "response"
    pieces = F.when(response, F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).otherwise(F.lit(1)).cast("int")
    cut = typed.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    data = F.when(response, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return cut.select(F.col("record_id").cast("string"), "target_uri", "record_type", F.col("refers_to").cast("string"), "payload_bytes", "payload_digest", "chunk_no", data.alias("data"))


def write_archives(rows: DataFrame, payload: Column, path: str, *, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of (record_id, target_uri, ...) to new archives in the folder ``path``."""
    rows.sparkSession.dataSource.register(WarcSource)
    chunk_rows(with_types(rows, payload), chunk).write.format("warc").option("archiveBytes", archive_bytes).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows of the archives in a folder, or of one archive, plain or gzipped.

    Columns: record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest as the header
    states them, chunk_no, data, position (payload bytes with this chunk), running_digest of those, is_last.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("chunkBytes", chunk).option("data", str(data).lower()).load(path)


def archived_pages(pages: DataFrame, *, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read back a row per record.

    page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, verified: a response's
    digest and length are those of the bytes read, a revisit's those its header states; ``verified`` says
    that a response's bytes have the stated digest and length.

    A null html is an empty payload, a null url leaves the target out, and a null page_id is a record
    without a number, which revisits a numbered one of equal payload but is never referred to. Rows that
    share the largest page_id of a group are all responses. Repeated rows are records of their own; an
    empty table gives none. Other columns are not read. Control characters of a url are percent-encoded.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), "html"), F.col("html"), path, chunk=chunk)
    last = read_archives(spark, path, chunk=chunk, data=False).filter("is_last")
    response = F.col("record_type") == "response"
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    return last.select(
        number("record_id").alias("page_id"), "target_uri",
        F.when(response, F.col("position")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(response, F.col("running_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"), (~response | ((F.col("running_digest") == F.col("payload_digest")) & (F.col("position") == F.col("payload_bytes")))).alias("verified"))
