"""GVF lines and the files that they go to, by hand-made transcripts."""

from pathlib import Path

from pyspark.sql import functions as F

from braidline.sources import gvf

ROWS = "g long, id long, gt string, exons array<struct<l:long,r:long>>, alleles array<struct<l:long,r:long,ale:string>>, n long"


def transcripts(spark):
    return spark.createDataFrame([
        (0, 1, "ALLELE1", [(30, 40), (0, 10)], [(30, 31, "C"), (4, 5, "A")], 2),
        (0, 2, "ALLELE2", [(2, 10), (30, 50)], [(4, 5, "T")], 1),
        (0, 3, "ALLELE1", [(0, 10), (60, 70)], [(4, 5, "A")], 3),
        (0, 4, "ALLELE2", [(0, 10), (80, 90)], None, 1),
        (0, 5, "UNPHASED", [(0, 10), (100, 120)], None, 1),
        (0, 6, "ALLELE1", [(0, 10)], None, 1),
        (0, 7, None, [], None, 1),
    ], ROWS)


def lines(df):
    return gvf.gvf_lines(df, F.lit("g0"), F.col("id").cast("string"), F.lit("chr1"), F.lit("-"), F.col("gt"), F.col("exons"), F.col("alleles"), F.col("n"), source="x")


def test_lines(spark):
    got = [r.line for r in lines(transcripts(spark)).where("id = 1").orderBy("nth").collect()]
    head = lambda f, l, r: f"chr1\tx\t{f}\t{l}\t{r}\t1000\t-\t.\tgene_id \"g0\"; transcript_id \"1\"; "
    assert got == [
        head("transcript", 1, 40) + 'allele "ALLELE1"; cov "2.0000"; ',
        head("exon", 1, 10) + 'exon "1"; ',
        head("variant", 5, 5) + 'exon "1"; seq "A"; allele "ALLELE1"; ',
        head("exon", 31, 40) + 'exon "2"; ',
        head("variant", 31, 31) + 'exon "2"; seq "C"; allele "ALLELE1"; ',
    ]
    assert lines(transcripts(spark)).where("id = 7").count() == 0


def test_files(spark, tmp_path):
    filed = gvf.by_specificity(transcripts(spark), ["g"])
    # the first two have the same introns; their ends do not matter
    assert {r.id: r.file for r in filed.collect()} == {1: gvf.FILES[0], 2: gvf.FILES[0], 3: gvf.FILES[1], 4: gvf.FILES[2], 5: gvf.FILES[0], 6: None, 7: None}
    out = str(tmp_path / "out")
    gvf.write_gvf(lines(filed), out, ["id", "nth"])
    read = spark.read.text(out)
    assert {r.file: r["count"] for r in read.groupBy("file").count().collect()} == {gvf.FILES[0]: 5 + 4 + 3, gvf.FILES[1]: 4, gvf.FILES[2]: 3}
    # a transcript's lines follow each other in one part
    for part in Path(out).rglob("part-*"):
        names = [x.split("transcript_id")[1].split(";")[0] for x in part.read_text().splitlines()]
        assert names == sorted(names)
