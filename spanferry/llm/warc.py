"""WARC archives as a PySpark Python data source.

Writing: each task writes one gzip member per record to files of its own, under names that no other attempt has; the
commit lists them in a manifest, so files of lost attempts are never read. Reading: partitions are whole files, planned
from the manifest (or the folder's ``*.warc`` and ``*.warc.gz`` files) in groups of about ``partitionBytes``. Record
type and header predicates are pushed down and decided on the header block; payloads nobody wants are skipped, not
decoded. Paths go through ``pyarrow.fs``, so local folders, HDFS and object stores work alike.

Columns: ``warc_type, record_id, target_uri, refers_to, payload_digest, content_length, payload``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from spanferry.operators.joins import lookup
from spanferry.shared import settle

SCHEMA = (
    "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "content_length long, payload binary"
)
MANIFEST = "_records.json"
PARTITION_BYTES = 32 * 1024 * 1024
FILE_BYTES = 64 * 1024 * 1024
BATCH_ROWS, BATCH_BYTES = 512, 8 * 1024 * 1024

# Header that holds each column.
_HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_length": "Content-Length",
}


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _storage(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    files: list[list]


def _lines(value: str) -> str:
    # A header is one line: what could end it is percent-encoded.
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unlined(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record of one row; null columns leave their header out, a null payload is empty."""
    payload = row.get("payload") or b""
    head = ["WARC/1.1"]
    for column, header in _HEADERS.items():
        value = len(payload) if column == "content_length" else row.get(column)
        if value is not None:
            text = str(value)
            if column in ("record_id", "refers_to"):
                text = f"<{text}>"
            elif column == "payload_digest":
                text = f"sha1:{text}"
            head.append(f"{header}: {_lines(text)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int) -> None:
        self.path, self.overwrite, self.file_bytes = path, overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        storage, base = _storage(self.path)
        storage.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = storage.open_output_stream(f"{base}/{files[-1][0]}", compression=None), 0
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record_bytes(row)) + pack.flush()
                out.write(member)
                size += len(member)
                files[-1][1] = size
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        storage, base = _storage(self.path)
        storage.create_dir(base, recursive=True)
        known = [] if self.overwrite else _manifest(storage, base) or []
        known += [f for m in messages if m is not None for f in m.files]
        with storage.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(known).encode())

    def abort(self, messages: list) -> None:
        storage, base = _storage(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else []:
                storage.delete_file(f"{base}/{name}")


def _manifest(storage: pafs.FileSystem, base: str) -> list | None:
    if storage.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with storage.open_input_stream(f"{base}/{MANIFEST}") as held:
        return json.loads(held.read())


class _Source:
    """Bytes of one archive in order, decompressed when it is gzip (one member or many), read or skipped."""

    def __init__(self, raw, packed: bool) -> None:
        self.raw, self.packed, self.ready, self.at = raw, packed, b"", 0
        self.unpack = zlib.decompressobj(31) if packed else None
        self.ended = False

    def _more(self) -> bool:
        while not self.ended:
            piece = self.raw.read(1 << 18)
            if not piece:
                self.ended = True
                return False
            if self.packed:
                out = []
                while piece:
                    out.append(self.unpack.decompress(piece))
                    piece = self.unpack.unused_data
                    if self.unpack.eof:
                        self.unpack = zlib.decompressobj(31)
                piece = b"".join(out)
            if piece:
                self.ready, self.at = self.ready[self.at :] + piece, 0
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        start = self.at
        while (found := self.ready.find(mark, start)) < 0:
            start = max(self.at, len(self.ready) - len(mark) + 1)
            held = start - self.at
            if not self._more():
                return None
            start = held
        out = self.ready[self.at : found + len(mark)]
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.ready[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
            if n and not self._more():
                raise ValueError("the archive ends inside a record")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            step = min(n, len(self.ready) - self.at)
            self.at += step
            n -= step
            if n and not self._more():
                raise ValueError("the archive ends inside a record")


def read_records(raw, packed: bool, wanted, payloads: bool) -> Iterator[dict]:
    """Records of one archive that ``wanted(headers)`` accepts; other records' bodies are passed over."""
    source = _Source(raw, packed)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        row = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
        row["content_length"] = length = int(row["content_length"])
        for column in ("record_id", "refers_to"):
            row[column] = row[column] and row[column].removeprefix("<").removesuffix(">")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        row = {c: _unlined(v) if isinstance(v, str) else v for c, v in row.items()}
        keep = wanted(row)
        if keep and payloads:
            row["payload"] = source.take(length)
        else:
            source.skip(length)
            row["payload"] = None
        source.skip(4)
        if keep:
            yield row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, partition_bytes: int) -> None:
        self.path, self.payloads, self.partition_bytes = path, payloads, partition_bytes
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership and presence tests of headers; leave the rest to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, (f.value,)))
            elif column in _HEADERS and isinstance(f, In):
                self.tests.append((column, tuple(f.value)))
            elif column in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        storage, base = _storage(self.path)
        files = _manifest(storage, base)
        if files is None:
            found = storage.get_file_info(pafs.FileSelector(base))
            files = [[i.base_name, i.size] for i in found if i.base_name.endswith((".warc", ".warc.gz")) and not i.base_name.startswith("_")]
        groups, size = [], self.partition_bytes
        for name, n in sorted(files):
            if size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [_Files(tuple(g)) for g in groups] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        storage, base = _storage(self.path)
        tests = self.tests

        def wanted(row: dict) -> bool:
            return all(row[c] is not None and (values is None or row[c] in values) for c, values in tests)

        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [*_HEADERS, "payload"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

        for name in partition.paths:
            with storage.open_input_stream(f"{base}/{name}", compression=None) as raw:
                for row in read_records(raw, name.endswith(".gz"), wanted, self.payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload=false`` reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("filebytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known to the session and let it push filters down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``pages`` as WARC records: a response with the payload, or a revisit that refers to the response.

    Of pages whose payloads are equal and have ``least_bytes`` or more, the one with the smallest id is the response
    (rows that repeat it too); smaller payloads are all responses. Null html is an empty payload. A null id counts only
    where a group has no other; its record has no number. Extra columns are ignored.

    Only payload digests and ids are grouped: a page moves just for the lookup of its digest among those that repeat.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    slim = rows.select("page_id", "sha1", F.octet_length("payload").alias("n"))
    repeated = settle(
        slim.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
        .where("c > 1").drop("c")
    )
    known = lookup(rows, repeated, ["sha1"], keys_of=slim)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))

    def named(column: Column) -> Column:
        return F.concat(F.lit("urn:page:"), column.cast("string"))

    return known.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(named(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, named(F.col("first"))).alias("refers_to"),
        base32(F.col("sha1")).alias("payload_digest"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hexadecimal: five hex digits are four base32 digits."""
    wide = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lpad(F.conv(F.substring(digest_hex, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(F.array_join(wide, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@F.arrow_udf(T.StringType())
def digest_of(payloads: pa.Array) -> pa.Array:
    return pa.array([None if p is None else payload_digest(p) for p in payloads.to_pylist()], pa.string())
