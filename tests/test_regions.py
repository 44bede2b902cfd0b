"""Regions, their parts and the rules on their graphs, on a small hand-made locus."""

import pytest

from braidline.operators import regions, rules

K = ["g"]


@pytest.mark.parametrize("width", [7, 10_000])
def test_a_locus_with_a_junction_and_a_site(spark, width):
    # two reads over a junction from 20 to 50, one of them with an allele at 12; one on the intron; one apart from all at 60
    blocks = [("x", 1, 0, 20), ("x", 1, 50, 70), ("x", 2, 5, 20), ("x", 2, 50, 60), ("x", 3, 30, 36)]
    blocks = spark.createDataFrame(blocks, "g string, id long, l long, r long")
    sites = spark.createDataFrame([("x", 12), ("x", 99)], "g string, p long")
    seen = spark.createDataFrame([("x", 1, 12, "A")], "g string, id long, p long, ale string")
    pieces = regions.split_by_sites(blocks, sites, seen, K, "id", width)
    assert sorted((r.id, r.l, r.r, r.ale) for r in pieces.collect()) == [(1, 0, 12, "$"), (1, 12, 13, "A"), (1, 13, 20, "$"), (1, 50, 70, "$"), (2, 5, 12, "$"), (2, 12, 13, "N"), (2, 13, 20, "$"), (2, 50, 60, "$"), (3, 30, 36, "$")]

    loci = spark.createDataFrame([("x", 0, 70)], "g string, l long, r long")
    junctions = spark.createDataFrame([("x", 20, 50)] * 2, "g string, a long, b long")
    alleles = spark.createDataFrame([("x", 12, 13, "A", 1), ("x", 12, 13, "N", 1)], "g string, l long, r long, ale string, n long")
    depths = regions.depth_of(pieces, K, width)
    found = regions.regions(loci, junctions, alleles, depths, K, width).orderBy("l", "ale")
    assert [(r.l, r.r, r.ale, r.ltype, r.rtype, round(r.ave, 3), r.high) for r in found.collect()] == [
        (0, 12, "$", regions.START, regions.SITE_LEFT, round(19 / 12, 3), 2),
        (12, 13, "A", regions.SITE_LEFT, regions.SITE_RIGHT, 1.0, 1),
        (12, 13, "N", regions.SITE_LEFT, regions.SITE_RIGHT, 1.0, 1),
        (13, 20, "$", regions.SITE_RIGHT, regions.LEFT, 2.0, 2),
        (20, 50, "$", regions.LEFT, regions.RIGHT, 0.2, 1),
        (50, 70, "$", regions.RIGHT, regions.END, 1.5, 2),
    ]

    known = spark.createDataFrame([("x", 12, "A", "ALLELE1"), ("x", 12, "C", "ALLELE2")], "g string, l long, ale string, gt string")
    parts = regions.genotyped(regions.numbered(regions.partial_exons(found, depths, K, width), K, "pid"), known, K)
    got = [(r.l, r.r, r.ale, r.ltype, r.rtype, r.empty) for r in parts.orderBy("pid").collect()]
    assert got[4] == (30, 36, "$", regions.START, regions.END, True) and len(got) == 6 and not any(x[5] for x in got[:4] + got[5:])

    ways = regions.ways_of_reads(pieces, found, parts, K, "id", width)
    assert {r.id: r.way for r in ways.collect()} == {1: [1, 2, 4, 6], 2: [1, 3, 4, 6], 3: [5]}
    vertices, edges = regions.splice_graph(parts, ways, K)
    assert vertices.count() == 6
    got = {(r.s, r.t): round(r.w, 3) for r in edges.collect()}
    assert got == {(0, 1): 1.583, (0, 5): 1.0, (1, 2): 1.0, (1, 3): 1.0, (2, 4): 1.0, (3, 4): 1.0, (4, 6): 2.0, (5, 7): 1.0, (6, 7): 1.5}
    trsts = {r.id: (r.gt, [tuple(x) for x in r.exons]) for r in rules.transcripts(ways, parts, K, "id").collect()}
    assert trsts == {1: ("ALLELE1", [(0, 20), (50, 70)]), 2: ("UNPHASED", [(0, 20), (50, 70)]), 3: ("UNPHASED", [(30, 36)])}


def test_stubs_at_splices_that_nothing_covers(spark):
    found = spark.createDataFrame([("x", 0, 40, "$", regions.RIGHT, regions.LEFT, None, 0.5, 1.0, 1)], "g string, l long, r long, ale string, ltype int, rtype int, n long, ave double, dev double, high long")
    depths = spark.createDataFrame([("x", 5, 25, 4)], "g string, l long, r long, depth long")
    got = sorted((r.l, r.r, r.ltype, r.rtype, r.ave, r.empty) for r in regions.partial_exons(found, depths, K, 100).collect())
    assert got == [(0, 1, regions.RIGHT, regions.END, 0.01, False), (5, 25, regions.START, regions.END, 4.0, False), (39, 40, regions.START, regions.LEFT, 0.01, False)]


def test_rules_on_a_graph(spark):
    # 1 and 3 are exons, 2 the intron between them, 4 a heavy one that little leads to, 5 small and apart
    rows = [(1, 0, 50, 9.0), (2, 50, 80, 1.0), (3, 80, 120, 9.0), (4, 200, 300, 80.0), (5, 400, 410, 1.0)]
    vertices = spark.createDataFrame([("x", v, l, r, "$", w, 1.0 if v != 5 else 0.0, 0, 0, False) for v, l, r, w in rows], "g string, v long, l long, r long, ale string, weight double, dev double, ltype int, rtype int, empty boolean")
    edges = spark.createDataFrame([("x", s, t, w) for s, t, w in [(0, 1, 9.0), (1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 2.0), (4, 6, 2.0), (0, 5, 1.0), (5, 6, 1.0)]], "g string, s long, t long, w double")
    ids = lambda df: sorted(r.v for r in df.collect())
    assert ids(rules.contaminated_introns(vertices, edges, K)) == [2]
    assert ids(rules.small_exons(vertices, edges, K)) == [5]
    assert ids(rules.inner_boundaries(vertices, edges, K)) == [5]
    assert [(r.v, r.side, r.w) for r in rules.extended_boundaries(vertices, edges, K).collect()] == [(4, "start", 78.0)]
    classes = rules.vertex_classes(vertices.selectExpr("g", "v", "l", "r", "if(v = 2, 'A', ale) ale", "1 ltype", "2 rtype"), edges, spark.createDataFrame([("x", 0, 500)], "g string, l long, r long"), K)
    assert {r.v: r["class"] for r in classes.collect()} == {1: "adjacent", 2: "allelic", 3: "adjacent", 4: "ordinary", 5: "ordinary"}
    assert rules.without_regional_graphs(classes, K).count() == 0
