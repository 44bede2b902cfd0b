"""GVF lines: transcripts with the alleles that lie in them, and text files by which allele a transcript is specific to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The files of transcripts of two exons or more that both alleles have, or one alone.
FILES = ("nonspec.multi-exon", "allele1spec.multi-exon", "allele2spec.multi-exon")


def gvf_lines(df: DataFrame, gene: Column, transcript: Column, seqname: Column, strand: Column, gt: Column, exons: Column, alleles: Column, cov: Column, source: str = "braidline") -> DataFrame:
    """df with a row, and columns line and nth (from 0), for each transcript, each of its exons and each allele in it.

    exons: array<struct<l, r>>, half-open from 0, none of them empty of exons (such rows give no line); alleles: null or
    array<struct<l, r, ale>>. Lines go by place, an exon before an allele at the same one; an allele's line has the
    number of exons that begin at it or before. A null column leaves out its part of the line.
    """
    own = F.transform(F.array_sort(exons), lambda x, i: F.struct(x["l"].alias("l"), F.lit("").alias("ale"), x["r"].alias("r"), (i + 1).cast("long").alias("exon")))
    inside = F.transform(F.coalesce(alleles, F.array()), lambda x: F.struct(x["l"].alias("l"), x["ale"].alias("ale"), x["r"].alias("r"), F.size(F.filter(exons, lambda e: e["l"] <= x["l"])).cast("long").alias("exon")))
    whole = F.array(F.struct(F.array_min(F.transform(exons, lambda x: x["l"])).alias("l"), F.lit("").alias("ale"), F.array_max(F.transform(exons, lambda x: x["r"])).alias("r"), F.lit(0).cast("long").alias("exon")))
    named = {"_gene": gene, "_t": transcript, "_seq": seqname, "_strand": strand, "_gt": gt, "_cov": cov}
    rows = df.where(F.size(exons) > 0).withColumns(named | {"_all": F.concat(whole, F.array_sort(F.concat(own, inside)))})
    rows = rows.select(*df.columns, *named, F.posexplode("_all").alias("nth", "_x"))
    ale, first = F.col("_x.ale"), F.col("nth") == 0
    pair = lambda name, value: F.concat(F.lit(f'{name} "'), value, F.lit('"; '))
    tail = F.when(first, F.concat_ws("", pair("allele", F.col("_gt")), pair("cov", F.format_string("%.4f", F.col("_cov").cast("double"))))).when(ale == "", pair("exon", F.col("_x.exon").cast("string"))).otherwise(F.concat_ws("", pair("exon", F.col("_x.exon").cast("string")), pair("seq", ale), pair("allele", F.col("_gt"))))
    feature = F.when(first, "transcript").when(ale == "", "exon").otherwise("variant")
    attributes = F.concat_ws("", pair("gene_id", F.col("_gene")), pair("transcript_id", F.col("_t")), tail)
    line = F.concat_ws("\t", "_seq", F.lit(source), feature, (F.col("_x.l") + 1).cast("string"), F.col("_x.r").cast("string"), F.lit("1000"), "_strand", F.lit("."), attributes)
    return rows.select(*df.columns, F.col("nth").cast("long").alias("nth"), line.alias("line"))


def by_specificity(df: DataFrame, keys: list[str], gt: str = "gt", exons: str = "exons") -> DataFrame:
    """df with column file (one of FILES; null for single exons): whether transcripts of both alleles have the same introns, or only those of one. One that is of neither allele counts for both."""
    ends = F.array_join(F.transform(F.array_sort(exons), lambda x: F.concat_ws("-", x["l"].cast("string"), x["r"].cast("string"))), ",")
    rows = df.withColumn("_introns", F.when(F.size(exons) > 1, F.regexp_replace(ends, r"^\d+-|-\d+$", "")))
    has = lambda other: F.bool_or(F.coalesce(F.col(gt) != other, F.lit(True)))
    found = rows.where("_introns is not null").groupBy(*keys, "_introns").agg(has("ALLELE2").alias("_1"), has("ALLELE1").alias("_2"))
    file = F.when(F.col("_1") & F.col("_2"), FILES[0]).when(F.col("_1"), FILES[1]).when(F.col("_2"), FILES[2])
    return rows.join(found, [*keys, "_introns"], "left").select(*df.columns, file.alias("file"))


def write_gvf(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text below path/file=..., a folder for each value of column file (rows without one are left out), each part in order, a transcript's lines together.

    The columns of order, without the last (nth), name a transcript; transcripts are dealt by ranges of these, so a large
    file is written by many tasks.
    """
    rows = lines.where("file is not null").repartitionByRange("file", *order[:-1]).sortWithinPartitions("file", *order)
    rows.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
