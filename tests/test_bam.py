"""The BAM source against the same alignments as SAM text, at any split size."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidline.sources import bam, sam

REFS = {"1": 248_956_422, "chrUn_KI:2": 5_000}


def lines(n=3000):
    rng = random.Random(3)
    for i in range(n):
        cigar = rng.choice(["10M", "5M10N5M", "3S4M2I1M", "*", "1M" * 120])
        seq = rng.choice(["*", "ACGTNACGTA", "ACGTNACGT", "A" * 300])
        tags = [t for t in (f"NH:i:{rng.randrange(9)}", f"HI:i:{rng.randrange(300)}", f"nM:i:{i}", "XS:A:-", "ts:A:+", "UB:Z:AC GT") if rng.random() < 0.5]
        if rng.random() < 0.1:
            tags.append("ZZ:Z:" + "x" * 90_000)  # longer than a block
        mate = rng.choice(["=", "*", "chrUn_KI:2"])
        yield [f"read{i}", rng.choice([99, 147, 16, 256]), rng.choice(["1", "chrUn_KI:2"]), i + 1, rng.randrange(256), cigar, mate, rng.randrange(1, 9000) if mate != "*" else 0, rng.randrange(-500, 500), seq, "*", *tags]


def as_bam(rows, content=60_000):
    """A BAM file by the format's description, apart from the code under test."""
    names, ops, bases = [*REFS], "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
    out = bytearray(b"BAM\1" + struct.pack("<i", 10) + b"@HD\tVN:1.\n" + struct.pack("<i", len(names)))
    for n, size in REFS.items():
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    for qname, flag, rname, pos, mapq, cigar, rnext, mpos, tlen, seq, _, *tags in rows:
        body = qname.encode() + b"\0"
        n, k = "", 0
        for c in cigar if cigar != "*" else "":
            if c.isdigit():
                n += c
            else:
                body += struct.pack("<I", int(n) << 4 | ops.index(c))
                n, k = "", k + 1
        seq = "" if seq == "*" else seq
        padded = seq + "=" * (len(seq) % 2)
        body += bytes(bases.index(a) << 4 | bases.index(b) for a, b in zip(padded[::2], padded[1::2], strict=True)) + b"\x1e" * len(seq)
        for t in tags:
            name, kind, value = t.split(":", 2)
            if kind == "i":
                v = int(value)
                body += name.encode() + (b"C" + struct.pack("B", v) if v < 256 else b"S" + struct.pack("<H", v))
            else:
                body += name.encode() + kind.encode() + value.encode() + (b"\0" if kind == "Z" else b"")
        body += b"BBBs" + struct.pack("<ihh", 2, -1, 5)
        number = lambda x: names.index(rname if x == "=" else x) if x != "*" else -1  # noqa: E731, B023
        fixed = struct.pack("<iiBBHHHiiii", number(rname), pos - 1, len(qname) + 1, mapq, 4680, k, flag, len(seq), number(rnext), mpos - 1, tlen)
        out += struct.pack("<i", len(fixed) + len(body)) + fixed + body
    return b"".join(bam.bgzf(bytes(out[i : i + content])) for i in range(0, len(out), content)) + bam.EOF


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rows, folder = list(lines()), tmp_path_factory.mktemp("bam")
    (folder / "x.sam").write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    (folder / "x.bam").write_bytes(as_bam(rows))
    return folder


@pytest.mark.parametrize("split", [1 << 26, 100_000, 30_011, 2_503])
def test_equals_sam_at_any_split(spark, files, split):
    got, want = bam.read_bam(spark, str(files / "x.bam"), split_bytes=split), sam.read_sam(spark, str(files / "x.sam"))
    assert got.columns == want.columns and (got.rdd.getNumPartitions() == 1) == (split == 1 << 26)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_only_named_columns(spark, files):
    got = bam.read_bam(spark, str(files), ["pos", "nm"], 50_000)
    assert got.columns == ["pos", "nm"] and got.count() == 3000 and got.agg(F.sum("pos")).first()[0] == sum(range(3000))


def test_large_files_have_several_partitions(tmp_path):
    with (tmp_path / "x.bam").open("wb") as f:
        f.truncate(256 << 20)
    reader = bam.BamReader(str(tmp_path / "x.bam"), T.StructType([T.StructField("pos", T.IntegerType())]), bam.SPLIT_BYTES)
    parts = reader.partitions()
    assert len(parts) == 4 and parts[0].start == 0 and parts[-1].end == 256 << 20


def test_damage_is_an_error(spark, files, tmp_path):
    data = bytearray((files / "x.bam").read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / "bad.bam").write_bytes(data)
    with pytest.raises(Exception, match="damaged|decompress|BGZF"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).count()
    (tmp_path / "no.bam").write_bytes(b"hello")
    with pytest.raises(Exception, match="BGZF|BAM"):
        bam.read_bam(spark, str(tmp_path / "no.bam")).count()


def test_round_trip(spark, files, tmp_path):
    reads = bam.read_bam(spark, str(files / "x.bam")).drop("rpos").repartition(3)
    bam.write_bam(reads, str(tmp_path / "out"), REFS)
    bam.write_bam(reads.where("pos < 10"), str(tmp_path / "out"), REFS)
    again = bam.read_bam(spark, str(tmp_path / "out"), split_bytes=70_000).drop("rpos")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, reads.union(reads.where("pos < 10")).collect()))
    bam.write_bam(reads.limit(0), str(tmp_path / "out"), REFS, mode="overwrite")
    assert bam.read_bam(spark, str(tmp_path / "out")).count() == 0
