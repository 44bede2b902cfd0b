"""WARC archives as a Python data source: spark.read.format("warc") and df.write.format("warc")."""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from ..runtime import cut, shared_dir, ship
from .skew import with_groups

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("record_type", T.StringType()), ("record_id", T.StringType()), ("target_uri", T.StringType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType()))])
#: A file's bytes, about, from which a writer begins another; the deflate level; the bytes read, and inflated, at a time.
FILE_BYTES, LEVEL, BLOCK, PIECE = 256 << 20, 1, 1 << 20, 4096
#: How the names of manifests, and of archives that a manifest has to name, begin.
MANIFEST, PART = "_commit-", "part-"
#: WARC header fields by column.
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Magic, method and flags; time; extra flags and system; length of the extra field; its name, length, and the two lengths.
_GZIP = struct.Struct("<4sIBBHBBHII")


def filesystem(path: str):
    """The file system and path of a path or URI."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return FileSystem.from_uri(path if ":" in path else posixpath.abspath(path))


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member, whose header says in the extra field "sl" how long it is and how long its content, so that readers can skip it."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _GZIP.size + len(body) + 8
    head = _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, ord("s"), ord("l"), 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response or revisit record; a revisit's block ends after the HTTP header, which keeps the full payload's length."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {''.join(row['target_uri'].split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _names(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    return sorted(x.base_name for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.type == FileType.File)


def archives(path: str) -> list[str]:
    """The archives that count in a folder (or the one file itself): those that a commit names and no later one replaces, and those of others."""
    from pyarrow.fs import FileType

    fs, root = filesystem(path)
    if fs.get_file_info(root).type == FileType.File:
        return [root]
    names, kept, gone = _names(fs, root), [], set()
    for m in names:
        if m.startswith(MANIFEST):
            with fs.open_input_stream(posixpath.join(root, m)) as f:
                told = json.loads(f.read())
            gone |= set(told["replaces"])
            kept.append((m, told["files"]))
    own = [x for m, files in kept if m not in gone for x in files]
    others = [x for x in names if x.endswith((".warc", ".warc.gz")) and not x.startswith(PART) and x not in gone]
    return [posixpath.join(root, x) for x in sorted({*own, *others})]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own name; each commit names those of the tasks that counted in a manifest of its own.

    Appends add up. With overwrite the manifest also names all that it replaces, so that readers see the old archives or
    the new ones; then the old ones are deleted.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{PART}{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(root, files[-1]), compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        new = sorted(x for m in messages if m for x in m.files)
        old = [x for x in _names(fs, root) if x not in new and (x.startswith(MANIFEST) or x.endswith((".warc", ".warc.gz")))] if self.overwrite else []
        with fs.open_output_stream(posixpath.join(root, f"{MANIFEST}{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps({"files": new, "replaces": old}).encode())
        for x in old:
            fs.delete_file(posixpath.join(root, x))

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(posixpath.join(root, x))


class _Window:
    """A file's bytes by place, through one buffer that moves forward; what is passed over is not read."""

    def __init__(self, f):
        self.f, self.end, self.base, self.data = f, f.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        """The n bytes from a place on; fewer at the file's end."""
        have = self.base + len(self.data)
        if place < self.base or place + n > have and have < self.end:
            kept = self.data[place - self.base :] if self.base <= place < have else b""
            self.f.seek(place + len(kept))
            self.data, self.base = kept + self.f.read(min(max(BLOCK, n), self.end - place) - len(kept)), place
        return self.data[place - self.base : place - self.base + n]


class _Plain:
    """The content of an archive that is not compressed."""

    next: int | None = None

    def __init__(self, window: _Window, place: int):
        self.window, self.place = window, place

    def peek(self, n: int) -> bytes:
        return self.window.at(self.place, n)

    def drop(self, n: int) -> None:
        self.place = min(self.place + n, self.window.end)


class _Member:
    """The content of a gzip member, inflated as far as it is asked for. next: where the following member begins, if the header says so."""

    def __init__(self, window: _Window, place: int):
        head = window.at(place, _GZIP.size)
        self.window, self.place = window, place
        told = len(head) == _GZIP.size and head[3] & 4 and head[12:14] == b"sl"
        self.next = place + struct.unpack_from("<I", head, 16)[0] if told else None
        self.inflate, self.text = zlib.decompressobj(31), bytearray()

    def peek(self, n: int) -> bytes:
        while len(self.text) < n and not self.inflate.eof:
            data = self.window.at(self.place, max(PIECE, min(BLOCK, (n - len(self.text)) // 8)))
            if not data:
                raise ValueError("the archive ends inside a record")
            self.text += self.inflate.decompress(data)
            self.place += len(data) - len(self.inflate.unused_data)
        return bytes(self.text[:n])

    def drop(self, n: int) -> None:
        while n > len(self.text):
            n -= len(self.text)
            self.text.clear()
            if not self.peek(1):
                return
        del self.text[:n]


_BLANK = b"\r\n\0"


def _head(content) -> bytes | None:
    """Takes a header up to its empty line from the content; None at the content's end."""
    while (first := content.peek(1)) and first in _BLANK:
        content.drop(1)
    n = PIECE
    while (end := (text := content.peek(n)).find(b"\r\n\r\n")) < 0 and len(text) == n:
        n *= 2
    if end < 0:
        if text:
            raise ValueError("the archive ends inside a header")
        return None
    content.drop(end + 4)
    return text[:end]


def _fields(head: bytes) -> dict[str, str]:
    """A header's fields by lower-case name; further lines of a field are joined to it."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.isdigit() else None


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """A partition for each file. Filters on the header columns are taken over; a record's headers are inflated first, and its payload only if they pass and the schema asks for it.

    Read are archives of gzip members (with or without lengths to skip by, of one record or several) and uncompressed ones. The payload is what
    follows the HTTP header in a block of HTTP, and the whole block of any other kind; payload_bytes is its length, but
    a revisit's is what its HTTP header says, null if it says nothing.
    """

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _FIELDS and isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(x) for x in archives(self.path)]

    def _passes(self, values: dict) -> bool:
        for f in self.tests:
            v = values[f.attribute[0]]
            ok = v is None if isinstance(f, IsNull) else v is not None and (isinstance(f, IsNotNull) or isinstance(f, EqualTo) and v == f.value or isinstance(f, In) and v in f.value or isinstance(f, StringStartsWith) and v.startswith(f.value))
            if not ok:
                return False
        return True

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            yield from self.rows(f)

    def rows(self, f) -> Iterator[tuple]:
        """The records of an open archive that pass."""
        names, window, at = self.schema.names, _Window(f), 0
        while at < window.end:
            first = window.at(at, 2)
            if first[:1] in (b"\r", b"\n", b"\0"):
                at += 1
                continue
            content = _Member(window, at) if first == b"\x1f\x8b" else _Plain(window, at)
            while (head := _head(content)) is not None:
                fields = _fields(head)
                values = {c: fields.get(k) for c, k in _FIELDS.items()}
                if values["payload_digest"]:
                    values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
                length = int(fields["content-length"])
                if self._passes(values):
                    values |= self._payload(content, fields, length, "payload" in names)
                    yield tuple(values.get(n) for n in names)
                elif content.next is None:
                    content.drop(length)
                if content.next is not None:
                    break
            at = content.place if content.next is None else content.next

    @staticmethod
    def _payload(content, fields: dict, length: int, wanted: bool) -> dict:
        """payload_bytes, and payload if wanted, of a block, which is taken from the content (or left there, if the next member's place is known)."""
        told, revisit = length, fields.get("warc-type") == "revisit"
        if fields.get("content-type", "").lower().startswith("application/http") and length:
            n = min(PIECE, length)
            while (end := content.peek(n).find(b"\r\n\r\n")) < 0 and n < length:
                n = min(2 * n, length)
            http = content.peek(n if end < 0 else end)
            content.drop(length if end < 0 else end + 4)
            length = 0 if end < 0 else length - end - 4
            told = _number(_fields(http).get("content-length")) if revisit else length
        elif revisit:
            told = None
        if wanted:
            payload = content.peek(length)
            if len(payload) < length:
                raise ValueError("the archive ends inside a record")
            content.drop(length)
            return {"payload_bytes": told, "payload": payload}
        if content.next is None:
            content.drop(length)
        return {"payload_bytes": told}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record_id(page_id: Column) -> Column:
    """The URN of a page's record: a UUID whose last 16 digits are the page_id's."""
    last = F.lpad(F.lower(F.hex(F.coalesce(page_id, F.lit(0)))), 16, "0")
    first = F.when(page_id.isNull(), F.lit("5ca1ab1e-0000-8001-")).otherwise(F.lit("5ca1ab1e-0000-8000-"))
    return F.concat(F.lit("<urn:uuid:"), first, F.substr(last, F.lit(1), F.lit(4)), F.lit("-"), F.substr(last, F.lit(5)), F.lit(">"))


def page_id(urn: Column) -> Column:
    """The page_id of a record's URN; null where it is not such a one."""
    digits = F.regexp_replace(F.regexp_extract(urn, r"^<urn:uuid:5ca1ab1e-0000-8000-([0-9a-f]{4}-[0-9a-f]{12})>$", 1), "-", "")
    # 64 bits by two halves, as conv() stops at signed longs
    high, low = (F.conv(F.substr(digits, F.lit(a), F.lit(8)), 16, 10).cast("long") for a in (1, 9))
    return F.when(F.length(digits) == 16, F.shiftleft(high, 32).bitwiseOR(low))


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """The record of every row: of rows with equal payloads of at least least_bytes bytes, those with the largest page_id are responses and the others revisit it; smaller ones are all responses.

    Null texts are empty payloads. Rows that repeat the largest page_id of a payload are all responses; null ids are
    smallest, and revisits of a payload that has no other ids refer to none, so these are responses too. Other columns
    are dropped.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= least_bytes)
    repeated = cut(large.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null"))
    rows = with_groups(own, repeated, "sha1", ["page_id", "target_uri"], pages.count())
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(revisit, record_id(F.col("last"))).alias("refers_to"),
        "payload",
    )


def write_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for every row to new archives in the shared folder, and reads their headers: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) and target_uri. See as_records."""
    spark = pages.sparkSession
    register(spark)
    path = shared_dir(spark)
    as_records(pages, id_col, url_col, html_col, least_bytes).write.format("warc").mode("append").save(path)
    headers = T.StructType([f for f in SCHEMA.fields if f.name != "payload"])
    read = spark.read.format("warc").schema(headers).load(path)
    return read.select(page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"), "target_uri")
