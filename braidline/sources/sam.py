"""SAM and VCF text files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignment import cigar_blocks, cigar_length, cigar_ops


def _tag(name: str, kind: str = "string") -> Column:
    return F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit("")).try_cast(kind)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """A row for each alignment: the columns of the format, positions from 0, the reference end, and the tags NH, HI, NM (or nM), XS, ts and UB."""
    line = spark.read.text(path).where("value <> '' and not startswith(value, '@')")
    c = F.split("value", "\t")
    rows = line.select(
        F.get(c, F.lit(0)).alias("qname"), F.get(c, F.lit(1)).try_cast("int").alias("flag"), F.get(c, F.lit(2)).alias("rname"), (F.get(c, F.lit(3)).try_cast("int") - 1).alias("pos"), F.get(c, F.lit(4)).try_cast("int").alias("mapq"), F.get(c, F.lit(5)).alias("cigar"),
        F.when(F.get(c, F.lit(6)) == "=", F.get(c, F.lit(2))).otherwise(F.get(c, F.lit(6))).alias("rnext"), (F.get(c, F.lit(7)).try_cast("int") - 1).alias("mpos"), F.get(c, F.lit(8)).try_cast("int").alias("tlen"), F.get(c, F.lit(9)).alias("seq"),
        _tag("NH", "int").alias("nh"), _tag("HI", "int").alias("hi"), F.coalesce(_tag("NM", "int"), _tag("nM", "int")).alias("nm"), _tag("XS").alias("xs"), _tag("ts").alias("ts"), _tag("UB").alias("umi"),
    )
    return finished(rows)


def finished(rows: DataFrame) -> DataFrame:
    """Adds the reference end, and the strand from ts where XS is missing."""
    # ts is of the read's own strand
    turned = F.when(F.col("flag").bitwiseAND(F.lit(0x10)) != 0, F.translate("ts", "+-", "-+")).otherwise(F.col("ts"))
    return rows.withColumn("rpos", F.col("pos") + cigar_length(F.col("cigar"))).withColumn("xs", F.coalesce("xs", turned, F.lit(".")))


def usable(reads: DataFrame, secondary: bool = False, least_mapq: int = 1, most_ops: int = 100, unique: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Mapped reads of enough quality and not too many CIGAR operations; primary ones only, unless secondary; uniquely mapped ones if unique."""
    good = (F.col("flag").bitwiseAND(F.lit(0x4)) == 0) & (F.col("rname") != "*") & (F.col("mapq") >= least_mapq) & F.size(cigar_ops(F.col("cigar"))).between(1, most_ops)
    if not secondary:
        good &= F.col("flag").bitwiseAND(F.lit(0x100)) == 0
    if unique:
        good &= F.col("nh") == 1
    if exclude:
        good &= ~F.col("rname").isin(*exclude)
    return reads.where(good)


def reach(reads: DataFrame, most: int = 100_000) -> DataFrame:
    """Adds reach: the read's end, or its mate's place where that is not much further on."""
    ahead = (F.col("mpos") > F.col("rpos")) & (F.col("mpos") <= F.col("rpos") + most) & (F.col("rnext") == F.col("rname"))
    return reads.withColumn("reach", F.when(ahead, F.col("mpos")).otherwise(F.col("rpos")))


def splices(reads: DataFrame) -> DataFrame:
    """A row (l, r) for each skipped stretch of each read."""
    return reads.withColumn("_x", F.explode(cigar_blocks(F.col("pos"), F.col("cigar"), "N"))).select("*", "_x.l", "_x.r").drop("_x")


def blocks(reads: DataFrame) -> DataFrame:
    """A row (l, r) for each aligned stretch of each read."""
    return reads.withColumn("_x", F.explode(cigar_blocks(F.col("pos"), F.col("cigar"), "M=X"))).select("*", "_x.l", "_x.r").drop("_x")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, allele, gt, ref_len): a row for each allele of each site, reference included, with its genotype in the last sample; alleles that the sample has not are left out."""
    from ..functions.alignment import genotype

    c = F.split("value", "\t")
    line = spark.read.text(path).where("value <> '' and not startswith(value, '#')").where(F.startswith(F.get(c, F.lit(8)), F.lit("GT")))
    alleles = F.concat(F.array(F.get(c, F.lit(3))), F.split(F.get(c, F.lit(4)), ","))
    rows = line.select(F.get(c, F.lit(0)).alias("chrom"), (F.get(c, F.lit(1)).try_cast("int") - 1).alias("pos"), F.length(F.get(c, F.lit(3))).alias("ref_len"), F.try_element_at(c, F.lit(-1)).alias("sample"), F.posexplode(alleles).alias("n", "allele"))
    return rows.select("chrom", "pos", F.upper("allele").alias("allele"), genotype(F.col("sample"), F.col("n")).alias("gt"), "ref_len").where("gt is not null")
