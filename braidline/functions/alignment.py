"""Column functions on alignments, variants and coded lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits.
PAIRED, UNMAPPED, REVERSE, FIRST, LAST, SECONDARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string; empty for a star."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n"), F.substr(x, F.length(x)).alias("op")))


def cigar_length(cigar: Column, ops: str = "MDN=X") -> Column:
    """Bases that the given operations take: of the reference by default; MIS=X: of the read."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.lit(ops).contains(x["op"])), F.lit(0), lambda a, x: a + x["n"])


def cigar_blocks(pos: Column, cigar: Column, ops: str) -> Column:
    """array<struct<l, r>>: where on the reference operations of these kinds stand; insertions by the two bases around them."""
    step = lambda x: F.when(F.lit("MDN=X").contains(x["op"]), x["n"]).otherwise(F.lit(0))
    empty = F.struct(pos.cast("int").alias("at"), F.array().cast("array<struct<l:int,r:int,op:string>>").alias("out"))
    piece = lambda a, x: F.struct(F.when(x["op"] == "I", a["at"] - 1).otherwise(a["at"]).cast("int").alias("l"), F.when(x["op"] == "I", a["at"] + 1).otherwise(a["at"] + step(x)).cast("int").alias("r"), x["op"].alias("op"))
    walked = F.aggregate(cigar_ops(cigar), empty, lambda a, x: F.struct((a["at"] + step(x)).cast("int").alias("at"), F.concat(a["out"], F.array(piece(a, x))).alias("out")))
    return F.transform(F.filter(walked["out"], lambda x: F.lit(ops).contains(x["op"])), lambda x: F.struct(x["l"], x["r"]))


def strand(flag: Column, library: str, xs: Column | None = None) -> Column:
    """+ or - by library type (fr_first, fr_second) and flag; the XS tag, else a dot, where the library is unstranded."""
    if library == "unstranded":
        return F.coalesce(xs, F.lit(".")) if xs is not None else F.lit(".")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    forward = F.when(bit(PAIRED) & bit(LAST), bit(REVERSE)).otherwise(~bit(REVERSE))
    plus = ~forward if library == "fr_first" else forward
    return F.when(plus, "+").otherwise("-")


def genotype(sample: Column, allele: Column) -> Column:
    """The genotype of allele number allele by a VCF sample's GT: ALLELE1, ALLELE2, NONSPECIFIC where both are it, UNPHASED where not phased or missing; null where neither is it."""
    gt = F.split(sample, ":")[0]
    phased, parts = gt.contains("|"), F.split(gt, "[|/]")
    a, b = F.try_element_at(parts, F.lit(1)).cast("string") == allele.cast("string"), F.try_element_at(parts, F.lit(2)).cast("string") == allele.cast("string")
    return F.when(gt.contains("."), "UNPHASED").when(a & b, "NONSPECIFIC").when(~phased & (a | b), "UNPHASED").when(a, "ALLELE1").when(b, "ALLELE2")


def gt_conflict(a: Column, b: Column) -> Column:
    """Whether two genotypes are the two alleles."""
    one, two = F.lit("ALLELE1"), F.lit("ALLELE2")
    return ((a == one) & (b == two)) | ((a == two) & (b == one))


def gt_same(a: Column, b: Column, implicit: bool = False) -> Column:
    """Whether two genotypes are equal and known; implicit: unphased and nonspecific also agree."""
    loose = F.array(F.lit("UNPHASED"), F.lit("NONSPECIFIC"))
    same = (a == b) & (a != "UNPHASED")
    return same | (F.array_contains(loose, a) & F.array_contains(loose, b)) if implicit else same


def reverse_complement(dna: Column) -> Column:
    """The other strand; IUPAC codes are turned too, anything else becomes N."""
    known = F.regexp_replace(F.upper(dna), "[^ACGTNRYSWKMBDHV]", "N")
    return F.reverse(F.translate(known, "ACGTNRYSWKMBDHV", "TGCANYRSWMKVHDB"))


def run_length(v: str) -> Column:
    """array<struct<start, len>>: the runs of consecutive numbers of an ascending array; repeats count once."""
    start = F.array().cast("array<struct<start:bigint,len:bigint>>")

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), (last["len"] + 1).alias("len"))))
        new = F.concat(out, F.array(F.struct(x.alias("start"), F.lit(1).cast("bigint").alias("len"))))
        return F.when((F.size(out) > 0) & (last["start"] + last["len"] == x), grown).otherwise(new)

    return F.aggregate(F.array_distinct(v), start, add)


def expanded(runs: str) -> Column:
    """The numbers of run_length()."""
    return F.flatten(F.transform(runs, lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))


def subset_at(ref: str, x: str) -> Column:
    """The places, from 0, at which array x stands in array ref."""
    last = F.size(ref) - F.size(x)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(ref, i + 1, F.size(x)) == F.col(x)))
