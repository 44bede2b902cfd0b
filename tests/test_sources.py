"""Text sources on hand-made lines."""

from braidline.sources import sam


def lines(tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    return str(tmp_path / name)


def test_reads(spark, tmp_path):
    path = lines(tmp_path, "x.sam", [
        ["@HD", "VN:1.6"],
        ["a", 99, "1", 101, 60, "5M10N5M", "=", 201, 120, "ACGTACGTAC", "*", "NH:i:1", "XS:A:-", "nM:i:2"],
        ["b", 16, "1", 151, 60, "10M", "*", 0, 0, "ACGTACGTAC", "*", "NH:i:3", "ts:A:+"],
        ["c", 4, "*", 0, 0, "*", "*", 0, 0, "A", "*"],
        ["d", 256, "1", 301, 60, "10M", "*", 0, 0, "A", "*"],
    ])
    reads = sam.read_sam(spark, path)
    good = {r.qname: r for r in sam.reach(sam.usable(reads)).collect()}
    assert set(good) == {"a", "b"}
    assert (good["a"].pos, good["a"].rpos, good["a"].reach, good["a"].xs, good["a"].nm) == (100, 120, 200, "-", 2)
    assert (good["b"].xs, good["b"].reach) == ("-", 160)
    assert [r.qname for r in sam.usable(reads, unique=True).collect()] == ["a"] and sam.usable(reads, exclude=("1",)).count() == 0
    assert [(r.l, r.r) for r in sam.splices(sam.usable(reads)).collect()] == [(105, 115)]
    assert sorted((r.l, r.r) for r in sam.blocks(sam.usable(reads)).collect()) == [(100, 105), (115, 120), (150, 160)]


def test_variants(spark, tmp_path):
    path = lines(tmp_path, "x.vcf", [
        ["##fileformat=VCFv4.2"],
        ["1", 11, ".", "a", "g", ".", ".", ".", "GT", "0|1"],
        ["1", 21, ".", "A", "C,T", ".", ".", ".", "GT:DP", "2|1:7"],
        ["1", 31, ".", "A", "C", ".", ".", ".", "GT", "1|1"],
        ["1", 41, ".", "AT", "C", ".", ".", ".", "GT", "0/1"],
        ["1", 51, ".", "A", "C", ".", ".", ".", "GT", "./."],
        ["1", 61, ".", "A", "C", ".", ".", ".", "DP", "1"],
    ])
    got = {(r.pos, r.allele): (r.gt, r.ref_len) for r in sam.read_vcf(spark, path).collect()}
    assert got == {
        (10, "A"): ("ALLELE1", 1), (10, "G"): ("ALLELE2", 1), (20, "T"): ("ALLELE1", 1), (20, "C"): ("ALLELE2", 1), (30, "C"): ("NONSPECIFIC", 1),
        (40, "AT"): ("UNPHASED", 2), (40, "C"): ("UNPHASED", 2), (50, "A"): ("UNPHASED", 1), (50, "C"): ("UNPHASED", 1),
    }
