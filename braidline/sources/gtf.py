"""GTF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute names that mean coverage.
COVERAGE = ("cov", "coverage", "expression", "expr")


def gtf_lines(df: DataFrame, gene: str, transcript: Column, seqname: str, strand: Column, exons: str, cov: str, source: str = "braidline") -> DataFrame:
    """df with a row, and column line, for each transcript and for each of its exons; exons: array<struct<l, r>>, half-open from 0."""
    each = F.concat(
        F.array(F.struct(F.lit("transcript").alias("feature"), F.array_min(F.transform(exons, lambda x: x["l"])).alias("l"), F.array_max(F.transform(exons, lambda x: x["r"])).alias("r"))),
        F.transform(exons, lambda x: F.struct(F.lit("exon").alias("feature"), x["l"].alias("l"), x["r"].alias("r"))),
    )
    rows = df.withColumn("_t", transcript).withColumn("_s", strand).withColumn("_x", F.explode(each))
    attributes = F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), "_t", F.lit('";'), F.when(F.col("_x.feature") == "transcript", F.concat(F.lit(' cov "'), cov, F.lit('";'))).otherwise(""))
    line = F.concat_ws("\t", seqname, F.lit(source), "_x.feature", (F.col("_x.l") + 1).cast("string"), F.col("_x.r").cast("string"), F.lit("1000"), "_s", F.lit("."), attributes)
    return rows.withColumn("line", line).drop("_t", "_s", "_x")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """The lines of GTF files: the nine columns, with starts from 0, and the attributes that transcripts have."""
    line = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    parts = line.select(F.split("value", "\t").alias("c")).where("size(c) >= 9")
    attribute = lambda *names: F.coalesce(*(F.nullif(F.regexp_extract(F.get("c", F.lit(8)), rf'(?:^|;)\s*{n} "?([^";]*)"?', 1), F.lit("")) for n in names))
    return parts.select(
        F.get("c", F.lit(0)).alias("seqname"), F.get("c", F.lit(1)).alias("source"), F.get("c", F.lit(2)).alias("feature"), (F.get("c", F.lit(3)).try_cast("int") - 1).alias("start"), F.get("c", F.lit(4)).try_cast("int").alias("end"), F.expr("try_cast(get(c, 5) as double)").alias("score"), F.get("c", F.lit(6)).alias("strand"), F.get("c", F.lit(7)).alias("frame"),
        *(attribute(n).alias(n) for n in ("gene_id", "transcript_id", "gene_type", "transcript_type")), attribute(*COVERAGE).try_cast("double").alias("coverage"), *(attribute(n).try_cast("double").alias(n) for n in ("RPKM", "FPKM", "TPM")),
    )
