"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from braidline.functions import alignment
from braidline.operators import graph, intervals, paths
from braidline.sources.gtf import gtf_lines, read_gtf


def test_coverage_of_hand_made_intervals(spark):
    rows = [(7, 10, 3), (6, 7, 3), (1, 3, 3), (1, 2, 1), (2, 5, 2)]
    df = spark.createDataFrame([("c", l, r) for l, r, n in rows for _ in range(n)], "k string, l long, r long")
    for width in (2, 1000):
        got = sorted(tuple(x)[1:] for x in intervals.coverage(df, ["k"], width=width).collect())
        assert got == [(1, 2, 4), (2, 3, 5), (3, 5, 2), (6, 7, 3), (7, 10, 3)]


@pytest.mark.parametrize("width", [3, 10_000])
def test_sessions_do_not_depend_on_bins(spark, width):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", l := rng.randrange(500), l + rng.randrange(1, 12)) for _ in range(80)]
    want = {}
    for k in "ab":
        reach = start = None
        for _, l, r in sorted(x for x in rows if x[0] == k):
            if reach is None or l > reach + 5:
                start = l
            reach = r if reach is None else max(reach, r)
            want[k, start] = want.get((k, start), 0) + 1
    got = intervals.sessionize(spark.createDataFrame(rows, "k string, l long, r long"), ["k"], gap=5, width=width).groupBy("k", "locus").count()
    assert {(r.k, r.locus): r["count"] for r in got.collect()} == want


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60), ("b", 10, 1)], "k string, t long, v long")
    got = {(r.k, r.t): r.v for r in intervals.asof(left, right, ["k"], "t", ["v"], width=2).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_components_of_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[200] == 200


def test_dead_ends_go(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1), ("g", 1, 9, 1), ("g", 1, 2, 1), ("g", 2, 3, 1), ("g", 5, 9, 1)], "g string, s long, t long, w long")
    assert sorted((r.s, r.t) for r in graph.prune_dead_ends(edges, 0, 9, ["g"]).collect()) == [(0, 1), (1, 9)]


def test_empty_inputs(spark):
    edges = spark.createDataFrame([], "g string, s long, t long, w long")
    assert graph.prune_dead_ends(edges, 0, 9, ["g"]).count() == graph.path_counts(edges, 0, ["g"]).count() == 0
    assert paths.decomposed(edges, ["g"], 0, 9).count() == 0
    assert intervals.coverage(spark.createDataFrame([], "k string, l long, r long"), ["k"]).count() == 0


def test_cigar_and_genotype(spark):
    df = spark.createDataFrame([(100, "5S10M2I3M7N4M1D2M", "0|1:9")], "pos int, cigar string, s string")
    row = df.select(
        alignment.cigar_length(F.col("cigar")).alias("ref"), alignment.cigar_length(F.col("cigar"), "MIS=X").alias("read"), alignment.cigar_blocks(F.col("pos"), F.col("cigar"), "M").alias("m"),
        alignment.cigar_blocks(F.col("pos"), F.col("cigar"), "N").alias("n"), alignment.genotype(F.col("s"), F.lit("1")).alias("gt"), alignment.genotype(F.col("s"), F.lit("0")).alias("ref_gt"),
    ).first()
    assert (row.ref, row.read, row.gt, row.ref_gt) == (27, 26, "ALLELE2", "ALLELE1")
    assert [tuple(x) for x in row.m] == [(100, 110), (110, 113), (120, 124), (125, 127)] and [tuple(x) for x in row.n] == [(113, 120)]


def test_runs_and_subsets(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 8, 20], [7, 8])], "v array<long>, x array<long>").withColumn("runs", alignment.run_length("v"))
    row = df.select("runs", alignment.expanded("runs").alias("back"), alignment.subset_at("v", "x").alias("at"), "v").first()
    assert [tuple(r) for r in row.runs] == [(1, 3), (7, 2), (20, 1)] and row.back == row.v and row["at"] == [3]


def test_gtf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c", "g", "2.5", [(9, 20), (30, 40)])], "seq string, g string, cov string, exons array<struct<l:int,r:int>>")
    gtf_lines(df, "g", F.lit("g.0"), "seq", F.lit("-"), "exons", "cov").select("line").write.text(str(tmp_path / "x"))
    got = sorted((r.feature, r.start, r.end, r.coverage, r.gene_id) for r in read_gtf(spark, str(tmp_path / "x")).collect())
    assert got == [("exon", 9, 20, None, "g"), ("exon", 30, 40, None, "g"), ("transcript", 9, 40, 2.5, "g")]


def test_large_graphs_go_by_rounds_with_the_same_ways(spark):
    rng = random.Random(3)
    rows = {(g, s, t): float(rng.randrange(1, 20)) for g in "ab" for s in range(8) for t in range(s + 1, 9) if rng.random() < 0.6}
    edges = spark.createDataFrame([(*k, w) for k, w in rows.items()], "g string, s long, t long, w double")
    want = sorted(map(tuple, paths.decomposed(edges, ["g"], 0, 8).collect()))
    assert want and sorted(map(tuple, paths.decomposed(edges, ["g"], 0, 8, vertices=2).collect())) == want


def test_streamed_loci_take_late_rows_and_end(spark, tmp_path):
    from braidline.runtime import shared_dir
    from braidline.streaming.loci import stream_loci

    hour, schema = 3_600_000_000, "chrom long, l long, r long"
    files = [[(1, 10, 3), (1, 5, 2), (2, 4, 1)], [(1, 12, 2), (1, 30, 1), (1, 29, 1)], [(1, 200, 1), (2, 300, 1)], [(2, 900, 1)]]
    for i, rows in enumerate(files):
        made = [(c, l * hour, (l + n) * hour) for c, l, n in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    out = shared_dir(spark)
    stream_loci(stream, 2 * hour, "20 hours").writeStream.outputMode("append").option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = sorted((r.chrom, r.l // hour, r.r // hour, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(1, 5, 7, 1), (1, 10, 14, 2), (1, 29, 31, 2), (1, 200, 201, 1), (2, 4, 5, 1), (2, 300, 301, 1)]


def test_clusters_do_not_depend_on_bins(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a" if rng.random() < 0.8 else "b", rng.randrange(400), i) for i in range(90)], "k string, x long, i long")
    made = [sorted(map(tuple, paths.clusters(df, ["k"], "x", ["i"], 4, width).collect())) for width in (3, 10_000)]
    assert made[0] == made[1] and len({r[-1] for r in made[0]}) > 5


def test_strands_and_genotypes_that_agree(spark):
    # single read; first and last of a pair, each also reversed
    flags = spark.createDataFrame([(0, None), (16, "+"), (0x41, "-"), (0x51, None), (0x81, None), (0x91, None)], "flag int, xs string")
    got = flags.select(alignment.strand(F.col("flag"), "fr_first").alias("a"), alignment.strand(F.col("flag"), "fr_second").alias("b"), alignment.strand(F.col("flag"), "unstranded", F.col("xs")).alias("c")).collect()
    assert "".join(r.b for r in got) == "+-+--+" and "".join(r.a for r in got) == "-+-++-" and "".join(r.c for r in got) == ".+-..."
    names = ["ALLELE1", "ALLELE2", "NONSPECIFIC", "UNPHASED"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rows = {(r.a, r.b): (r.x, r.y, r.z) for r in pairs.select("a", "b", alignment.gt_conflict(F.col("a"), F.col("b")).alias("x"), alignment.gt_same(F.col("a"), F.col("b")).alias("y"), alignment.gt_same(F.col("a"), F.col("b"), True).alias("z")).collect()}
    assert {k for k, v in rows.items() if v[0]} == {("ALLELE1", "ALLELE2"), ("ALLELE2", "ALLELE1")}
    assert {k for k, v in rows.items() if v[1]} == {(n, n) for n in names[:3]}
    assert {k for k, v in rows.items() if v[2]} == {(n, n) for n in names} | {(names[2], names[3]), (names[3], names[2])}
