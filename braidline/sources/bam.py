"""BAM files as a Spark data source: read in byte ranges, written a file for each task.

A BAM file is a chain of BGZF blocks (gzip members that name their own length) with records that may go on from block to
block. A partition is a range of bytes of a file. It has the records that begin in blocks that begin in its range: it
finds its first block by the block's fixed bytes and those of the blocks after it, and its first record by the lengths
and limits of the records' fields, which have to fit one another over several records.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..runtime import ship

#: Bytes of a partition, unless the option splitBytes says otherwise, and records of a batch.
SPLIT_BYTES, BATCH = 64 << 20, 8192
#: Fixed values of the format: the ends of its files, operations of a CIGAR, letters of bases, sizes of tag values.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_CODES = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
_FIXED = struct.Struct("<iiiBBHHHiiii")  # length, reference, place, lengths and quality, mate, insert
_FIXED_TYPE = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
#: Records that have to follow one another for a first record to be believed, and bytes that are searched for one at most.
CHAIN, LARGEST_RECORD = 8, 1 << 28
#: The largest content of a block, and the most bytes of a block.
CONTENT, BLOCK = 0xFF00, 1 << 16

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, mpos int, tlen int, seq string, nh int, hi int, nm int, xs string, ts string, umi string"
_TAGS = {"nh": ("NH",), "hi": ("HI",), "nm": ("NM", "nM"), "xs": ("XS",), "ts": ("ts",), "umi": ("UB",)}


def _filesystem(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    path = re.sub("^file:/(?!/)", "file:///", path)
    return FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (LocalFileSystem(), path)


def bgzf(content: bytes) -> bytes:
    """One BGZF block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return EOF[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


class Blocks:
    """A file's BGZF blocks, from one on, by its bytes."""

    def __init__(self, f, size: int):
        self.f, self.size, self.first, self.data = f, size, 0, b""

    def bytes_at(self, place: int, n: int) -> bytes:
        if not self.first <= place <= place + n <= self.first + len(self.data):
            self.f.seek(place)
            self.first, self.data = place, self.f.read(max(n, 1 << 20))
        return self.data[place - self.first :][:n]

    def length(self, place: int) -> int:
        """Of the block at a place; 0 where none can be."""
        head = self.bytes_at(place, 18)
        if len(head) < 18 or head[:4] != EOF[:4] or head[12:16] != EOF[12:16] or head[10:12] != EOF[10:12]:
            return 0
        return struct.unpack_from("<H", head, 16)[0] + 1

    def is_chain(self, place: int, n: int = 4) -> bool:
        for _ in range(n):
            if place == self.size:
                return True
            length = self.length(place)
            if not length or place + length > self.size:
                return False
            place += length
        return True

    def from_on(self, place: int) -> int:
        """The first block at or after a place, or the file's size."""
        while place < self.size:
            head = self.bytes_at(place, BLOCK + 18)
            at = head.find(EOF[:4])
            while at >= 0:
                if self.is_chain(place + at):
                    return place + at
                head = self.bytes_at(place, BLOCK + 18)
                at = head.find(EOF[:4], at + 1)
            place += max(1, len(head) - 3)
        return self.size

    def content(self, place: int) -> tuple[bytes, int]:
        """(the inflated content, the next block's place)."""
        length = self.length(place)
        if not length:
            raise ValueError(f"no BGZF block at byte {place}")
        data = self.bytes_at(place, length)
        out = zlib.decompress(data[18:-8], -15)
        if zlib.crc32(out) != struct.unpack_from("<I", data, length - 8)[0]:
            raise ValueError(f"the BGZF block at byte {place} is damaged")
        return out, place + length


class _Inflated:
    """The content of blocks from a place on, as far as asked for, and where each block's content begins."""

    def __init__(self, blocks: Blocks, place: int):
        self.blocks, self.next, self.data = blocks, place, bytearray()
        self.dropped = 0  # bytes of content that are not kept any more
        self.starts: list[tuple[int, int]] = []  # (first byte of content, block's place)

    def more(self) -> bool:
        if self.next >= self.blocks.size:
            return False
        content, following = self.blocks.content(self.next)
        if content:
            self.starts.append((self.dropped + len(self.data), self.next))
            self.data += content
        self.next = following
        return True

    def holds(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def block_of(self, at: int) -> int:
        """The place of the block in which byte number at of what is kept lies."""
        at += self.dropped
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1]

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.dropped += n


def header(blocks: Blocks) -> tuple[list[str], int, int]:
    """(names of references, place of the block in which records begin, bytes of its content before them)."""
    inside = _Inflated(blocks, 0)
    if not inside.holds(8) or inside.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", inside.data, 4)[0]
    inside.holds(at + 4)
    names, n = [], struct.unpack_from("<i", inside.data, at)[0]
    at += 4
    for _ in range(n):
        inside.holds(at + 4)
        size = struct.unpack_from("<i", inside.data, at)[0]
        inside.holds(at + 8 + size)
        names.append(inside.data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    if not inside.holds(at + 1):
        return names, blocks.size, 0
    place = inside.block_of(at)
    return names, place, at - inside.starts[0][0]


def _fits(data: bytearray, at: int, n_refs: int) -> int:
    """The length of a record that can begin here; 0 where none can, -1 where too few bytes are there to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name > 0 and 0 <= l_seq < LARGEST_RECORD):
        return 0
    least = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not least <= size < LARGEST_RECORD:
        return 0
    if at + 36 + l_name + 4 * n_ops > len(data):
        return -1
    name = data[at + 36 : at + 36 + l_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return 0
    if any(data[k] & 15 > 8 for k in range(at + 36 + l_name, at + 36 + l_name + 4 * n_ops, 4)):
        return 0
    return size + 4


def first_record(inside: _Inflated, n_refs: int, end: int) -> int | None:
    """Where in the content the first record begins, if that is in a block before end: from there, CHAIN records (or all to the file's end) fit."""
    at = 0
    while inside.holds(at + 1) and inside.block_of(at) < end:
        k, n = at, 0
        while n < CHAIN:
            length = _fits(inside.data, k, n_refs)
            if length < 0 and inside.more():
                continue
            if length < 0:
                length = 0 if k < len(inside.data) else -1
            if length <= 0:
                break
            k, n = k + length, n + 1
            if not inside.holds(k):
                length = 0
                break
        if n == CHAIN or n and k == len(inside.data) and not inside.holds(k + 1):
            return at
        at += 1
    return None


def _tags(data: bytes) -> dict[str, str]:
    """Tags of one value, as text; arrays are left out."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            out[name] = data[at:stop].decode("latin-1")
            at = stop + 1
        elif kind == "B":
            at += 5 + struct.unpack_from("<i", data, at + 1)[0] * TAG_SIZES[chr(data[at])]
        else:
            out[name] = chr(data[at]) if kind == "A" else str(struct.unpack_from(TAG_CODES[kind], data, at)[0])
            at += TAG_SIZES[kind]
    return out


class _Records:
    """Records of one stretch of content as columns, only those asked for."""

    def __init__(self, names: list[str], columns: list[str]):
        self.names, self.columns = np.array([*names, "*"], object), columns
        self.pairs = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]

    def batch(self, data: bytes, starts: list[int], schema: pa.Schema) -> pa.RecordBatch:
        at = np.array(starts, np.int64)
        fixed = np.frombuffer(np.frombuffer(data, np.uint8)[at[:, None] + np.arange(36)].tobytes(), _FIXED_TYPE)
        name_at = at + 36
        ops_at = name_at + fixed["l_name"]
        seq_at = ops_at + 4 * fixed["n_ops"].astype(np.int64)
        tags_at = seq_at + (fixed["l_seq"] + 1) // 2 + fixed["l_seq"]
        ends = at + 4 + fixed["size"]
        tags = [_tags(data[s:e]) for s, e in zip(tags_at.tolist(), ends.tolist(), strict=True)] if _TAGS.keys() & set(self.columns) else []
        ref, next_ref = self.names[fixed["ref"]], self.names[fixed["next_ref"]]  # -1: the star at the end
        make = {
            "qname": lambda: [data[s : e - 1].decode("latin-1") for s, e in zip(name_at.tolist(), ops_at.tolist(), strict=True)],
            "flag": lambda: fixed["flag"], "rname": lambda: ref, "pos": lambda: fixed["pos"], "mapq": lambda: fixed["mapq"],
            "cigar": lambda: [self._cigar(data, s, e) for s, e in zip(ops_at.tolist(), seq_at.tolist(), strict=True)],
            "rnext": lambda: next_ref, "mpos": lambda: fixed["next_pos"], "tlen": lambda: fixed["tlen"],
            "seq": lambda: ["".join(map(self.pairs.__getitem__, data[s : s + (n + 1) // 2]))[:n] or "*" for s, n in zip(seq_at.tolist(), fixed["l_seq"].tolist(), strict=True)],
        }
        out = []
        for field in schema:
            if field.name in make:
                values = make[field.name]()
                out.append(pa.array(values.astype(np.int32) if isinstance(values, np.ndarray) and values.dtype != object else values, field.type))
            else:
                found = [next((t[k] for k in _TAGS[field.name] if k in t), None) for t in tags]
                out.append(pa.array([int(x) if x is not None and field.type == pa.int32() else x for x in found], field.type))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    @staticmethod
    def _cigar(data: bytes, start: int, end: int) -> str:
        return "".join([f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{(end - start) // 4}I", data, start)]) or "*"


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    """Byte ranges of all files of a path (a file, a folder); columns that the schema leaves out are not decoded."""

    def __init__(self, path: str, schema: T.StructType, split_bytes: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema, self.split_bytes = path, to_arrow_schema(schema), split_bytes

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == FileType.File else [i for i in fs.get_file_info(FileSelector(root)) if i.type == FileType.File and i.base_name.endswith(".bam")]
        names = {i.path: self.path if i is info else f"{self.path.rstrip('/')}/{i.base_name}" for i in files}
        return [_Range(names[i.path], s, min(i.size, s + self.split_bytes)) for i in sorted(files, key=lambda i: i.path) for s in range(0, i.size, self.split_bytes)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(partition.path)
        with fs.open_input_file(path) as f:
            blocks = Blocks(f, f.size())
            names, first, skipped = header(blocks)
            if first >= partition.end:
                return
            if first >= partition.start:
                inside, at = _Inflated(blocks, first), skipped
            else:
                inside = _Inflated(blocks, blocks.from_on(partition.start))
                at = first_record(inside, len(names), partition.end)
                if at is None:
                    return
            records, starts = _Records(names, self.schema.names), []
            while inside.holds(at + 4) and inside.block_of(at) < partition.end:
                size = struct.unpack_from("<i", inside.data, at)[0] + 4
                if size < 36 or not inside.holds(at + size):
                    raise ValueError(f"{partition.path} ends within a record")
                starts.append(at)
                at += size
                if len(starts) == BATCH or at > 1 << 24:
                    yield records.batch(bytes(inside.data[:at]), starts, self.schema)
                    inside.drop(at)
                    at, starts = 0, []
            if starts:
                yield records.batch(bytes(inside.data[:at]), starts, self.schema)


def encoded(row: dict, numbers: dict[str, int]) -> bytes:
    """One record of a row with the columns of SCHEMA; missing columns and nulls have the format's empty values."""
    name = (row.get("qname") or "*").encode() + b"\0"
    cigar = re.findall(rf"(\d+)([{OPS}])", row.get("cigar") or "")
    seq = row.get("seq") or "*"
    seq = "" if seq == "*" else seq
    codes = [max(0, BASES.find(c)) for c in seq + "=" * (len(seq) % 2)]
    number = lambda key: numbers.get(row.get(key) or "*", -1)
    or_ = lambda key, default: default if row.get(key) is None else row[key]
    body = name + b"".join(struct.pack("<I", int(n) << 4 | OPS.index(op)) for n, op in cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(seq)
    for key, kinds in _TAGS.items():
        value = row.get(key)
        if value is not None:
            tag = kinds[0].encode()
            body += tag + (b"i" + struct.pack("<i", value) if key in ("nh", "hi", "nm") else b"A" + value.encode() if key in ("xs", "ts") else b"Z" + value.encode() + b"\0")
    fixed = _FIXED.pack(32 + len(body), number("rname"), or_("pos", -1), len(name), or_("mapq", 255), 0, len(cigar), or_("flag", 0), len(seq), number("rnext"), or_("mpos", -1), or_("tlen", 0))
    return fixed + body


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class BamWriter(DataSourceArrowWriter):
    """A file for each task, with the references that the option references names (comma-separated, as name:length)."""

    def __init__(self, path: str, references: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.references = [(n, int(size)) for n, _, size in (x.rpartition(":") for x in references.split(",") if x)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        numbers = {n: k for k, (n, _) in enumerate(self.references)}
        head = b"BAM\1" + struct.pack("<ii", 0, len(self.references)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.references)
        with fs.open_output_stream(f"{root}/.{name}") as f:
            held = bytearray(head)
            for batch in iterator:
                for row in batch.to_pylist():
                    held += encoded(row, numbers)
                    while len(held) >= CONTENT:
                        f.write(bgzf(bytes(held[:CONTENT])))
                        del held[:CONTENT]
            if held:
                f.write(bgzf(bytes(held)))
            f.write(EOF)
        return _Written(name)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, root = _filesystem(self.path)
        made = {m.name for m in messages if m is not None}
        if self.overwrite:
            for i in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if i.base_name.endswith(".bam") and not i.base_name.startswith("."):
                    fs.delete_file(i.path)
        for name in made:
            fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/.{m.name}")


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BamReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options["path"], self.options.get("references", ""), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The alignments of BAM files, with the columns of sam.read_sam(), or those of SCHEMA that columns names, which alone are decoded then."""
    from .sam import finished

    register(spark)
    kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
    rows = spark.read.format("bam").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("splitBytes", split_bytes).load(path)
    return rows if columns else finished(rows)


def write_bam(reads: DataFrame, path: str, references: dict[str, int], mode: str = "append") -> None:
    """Writes rows with columns of SCHEMA as BAM, a file for each task; references: all references' lengths by name."""
    register(reads.sparkSession)
    reads.write.format("bam").option("references", ",".join(f"{n}:{size}" for n, size in references.items())).mode(mode).save(path)
