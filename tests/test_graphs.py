"""Ways through graphs, and rules on splice graphs, against plain versions and hand-made cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidline.operators import graph, paths, regions, rules

K = ["g"]


def random_graphs(seed, n=30, most=14, share=0.4):
    rng, rows = random.Random(seed), []
    for g in range(n):
        size = rng.randrange(2, most)
        order = rng.sample(range(1, 100), size)  # vertices that do not ascend along edges
        rows += [(g, order[i], order[j], rng.randrange(1, 6)) for i in range(size) for j in range(i + 1, size) if rng.random() < share]
    return rows


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "g long, s long, t long, w long")


def by_graph(rows):
    out = defaultdict(list)
    for g, *e in rows:
        out[g].append(tuple(e))
    return out


def levels_of(edges):
    found = {}

    def level(v):
        if v not in found:
            found[v] = max((level(s) + 1 for s, t, _ in edges if t == v), default=0)
        return found[v]

    return {v: level(v) for e in edges for v in e[:2]}


def test_topological_levels(spark):
    rows = random_graphs(1)
    got = {(r.g, r.v): r.level for r in graph.topological_levels(edges_of(spark, rows), K).collect()}
    assert got == {(g, v): n for g, e in by_graph(rows).items() for v, n in levels_of(e).items()}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(edges_of(spark, [(0, 1, 2, 1), (0, 2, 3, 1), (0, 3, 2, 1)]), K)


def plain_best_ways(edges, source, most=10, kept=5):
    table = {source: [([999999] * kept, 1, [source])]}
    for v in sorted(levels := levels_of(edges), key=levels.get):
        new = [(sorted([*least, w])[:kept], length + 1, [*way, v]) for s, t, w in edges if t == v for least, length, way in table.get(s, [])]
        if new:
            table[v] = sorted(new, key=lambda x: ([-y for y in x[0]], x[1], x[2]))[:most]
    return table


def test_best_ways(spark):
    rows = random_graphs(2, n=12, most=10, share=0.9)
    sources = {(g, s) for g, s, _, _ in rows if s % 2}
    got = graph.best_ways(edges_of(spark, rows), spark.createDataFrame(list(sources), "g long, source long"), K).collect()
    want = [(g, s, v, n, x[0], x[1], x[2]) for g, s in sources for v, found in plain_best_ways(by_graph(rows)[g], s).items() for n, x in enumerate(found, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(x[3] == 10 for x in want)


def test_best_ways_by_lengths(spark):
    rows = [(0, 1, 2, 5), (0, 2, 4, 5), (0, 1, 3, 5), (0, 3, 4, 5)]
    lengths = spark.createDataFrame([(0, 1, 10), (0, 2, 30), (0, 3, 20), (0, 4, 1)], "g long, v long, length long")
    got = graph.best_ways(edges_of(spark, rows), spark.createDataFrame([(0, 1)], "g long, source long"), K, lengths)
    assert [(r.way, r.length) for r in got.where("v = 4").orderBy("nth").collect()] == [([1, 3, 4], 31), ([1, 2, 4], 41)]


def test_relaxed(spark):
    rows = random_graphs(3)
    got = graph.relaxed(edges_of(spark, rows), 50, K, F.lit(0).cast("long"), lambda a, w: a + w, F.min, "c")
    want = {}
    for g, e in by_graph(rows).items():
        cost, order = {50: 0}, levels_of(e)
        for v in sorted(order, key=order.get):
            if into := [cost[s] + w for s, t, w in e if t == v and s in cost]:
                cost[v] = min([*into, cost[v]] if v in cost else into)
        want |= {(g, v): c for v, c in cost.items()}
    assert {(r.g, r.v): r.c for r in got.collect()} == want


def plain_closure(edges, chosen):
    """Each direction by itself, one step after the other."""
    out = set(chosen)
    for own, other in ((0, 1), (1, 0)):
        reached = {e[other] for e in chosen}
        todo, done = [e[own] for e in chosen], set()
        while todo:
            v = todo.pop()
            beside = [e for e in edges if e[other] == v]
            if v in reached or v in done or not beside:
                continue
            done.add(v)
            e = max(beside, key=lambda e: (e[2], -e[own]))
            out.add(e[:2])
            todo.append(e[own])
    return out


def test_heaviest_ways(spark):
    rows, rng = random_graphs(4, most=30), random.Random(4)
    chosen = [r[:3] for r in rows if rng.random() < 0.05]
    got = graph.with_heaviest_ways(spark.createDataFrame(chosen, "g long, s long, t long"), edges_of(spark, rows), K)
    picked = by_graph([(*c, 0) for c in chosen])
    want = {(g, *e) for g, es in by_graph(rows).items() for e in plain_closure(es, {c[:2] for c in picked.get(g, [])})}
    assert {tuple(r) for r in got.collect()} == want and len(want) > len(chosen)
    line = [(0, i, i + 1, 1) for i in range(200)]
    assert graph.with_heaviest_ways(spark.createDataFrame([(0, 100, 101)], "g long, s long, t long"), edges_of(spark, line), K).count() == 200


def plain_surviving(vertices, edges, least=1.6, heaviest=1.5):
    gt, plain = {v: g for v, _, g in vertices}, {v: a == "$" for v, a, _ in vertices}
    chosen = {(s, t) for s, t, w in edges if w >= least}
    for mine, other in (("ALLELE1", "ALLELE2"), ("ALLELE2", "ALLELE1")):
        copy = [e for e in edges if other not in (gt.get(e[0]), gt.get(e[1]))]
        chosen |= plain_closure(copy, {e[:2] for e in copy if mine in (gt.get(e[0]), gt.get(e[1]))})
    inner, part = [e for e in edges if e[0] in gt and e[1] in gt], {v: v for v in gt}
    for _ in gt:
        for s, t, _ in inner:
            part[s] = part[t] = min(part[s], part[t])
    best = {}
    for s, t, w in inner:
        if plain[s] and plain[t] and w >= heaviest:
            best[part[s]] = max(best.get(part[s], (0,)), (w, s, t))
    return plain_closure(edges, chosen | {e[1:] for e in best.values()})


def test_surviving_edges(spark):
    rng, vertices, edges = random.Random(6), [], []
    for g in range(25):
        n = rng.randrange(2, 18)
        own = [(v, "$", "UNPHASED") if rng.random() < 0.7 else (v, rng.choice("AT"), rng.choice(["ALLELE1", "ALLELE2", "NONSPECIFIC"])) for v in range(1, n + 1)]
        vertices += [(g, *v) for v in own]
        edges += [(g, s, t, rng.choice([0.01, 0.5, 1.55, 1.6, 3.0])) for s in range(n + 1) for t in range(s + 1, n + 2) if rng.random() < (0.25 if t - s < 5 else 0.05)]
    frames = spark.createDataFrame(vertices, "g long, v long, ale string, gt string"), spark.createDataFrame(edges, "g long, s long, t long, w double")
    got = {(r.g, r.s, r.t) for r in rules.surviving_edges(*frames, K).collect()}
    own = by_graph(vertices)
    assert got == {(g, *e) for g, es in by_graph(edges).items() for e in plain_surviving(own[g], es)} and len(got) < len(edges)


VERTEX = "g long, v long, l long, r long, ale string, gt string, weight double, dev double, ltype int, rtype int, empty boolean"


def vertex(v, l, r, ale="$", gt="UNPHASED", weight=1.0, dev=0.0, empty=False):
    return (0, v, l, r, ale, gt, weight, dev, 1, 2, empty)


def test_inner_boundary_beside_an_empty_vertex(spark):
    # the only edge out of an empty vertex leads to a flat one: that stays
    vertices = spark.createDataFrame([vertex(1, 0, 10, empty=True), vertex(2, 10, 20)], VERTEX)
    assert rules.inner_boundaries(vertices, edges_of(spark, [(0, 0, 1, 1), (0, 1, 2, 1), (0, 2, 3, 1)]), K).count() == 0
    assert [r.v for r in rules.inner_boundaries(vertices, edges_of(spark, [(0, 0, 1, 1), (0, 1, 2, 1), (0, 1, 3, 1), (0, 2, 3, 1)]), K).collect()] == [2]


PARTS = "g long, pid long, l long, r long, ale string, gt string, ltype int, rtype int, ave double, dev double"


def test_parts_of_different_alleles_are_not_joined(spark):
    parts = spark.createDataFrame([(0, 1, 10, 11, "A", "ALLELE1", 16, 32, 3.0, 0.0), (0, 2, 11, 12, "C", "ALLELE2", 16, 32, 3.0, 0.0), (0, 3, 11, 12, "G", "ALLELE1", 16, 32, 3.0, 0.0)], PARTS)
    ways = spark.createDataFrame([], "g long, way array<long>")
    edges = {(r.s, r.t) for r in regions.splice_graph(parts, ways, K)[1].collect()}
    assert (1, 3) in edges and (1, 2) not in edges


def test_genotypes_are_looked_up(spark):
    known = spark.createDataFrame([(0, 5, "C", "ALLELE1"), (0, 5, "G", "ALLELE2"), (0, 9, "C", "NONSPECIFIC")], "g long, l long, ale string, gt string")
    sites = spark.createDataFrame([(0, 5, 6, "C", 2), (0, 9, 10, "C", 1), (0, 7, 8, "A", 1)], "g long, l long, r long, ale string, n long")
    sites = regions.genotyped(sites, known, K)
    assert {r.l: r.gt for r in sites.collect()} == {5: "ALLELE1", 9: "NONSPECIFIC", 7: "UNPHASED"}
    assert [(r.l, r.ale, r.gt) for r in rules.counter_alleles(sites, known, K).collect()] == [(5, "G", "ALLELE2")]
    assert [(r.l, r.n) for r in rules.lone_alleles(sites, K).collect()] == [(5, 2)] and rules.lone_alleles(sites, K, most=1).count() == 0
    parts = spark.createDataFrame([(0, 1, 0, 5, "UNPHASED"), (0, 2, 5, 6, "ALLELE2"), (0, 3, 6, 9, "UNPHASED"), (0, 4, 9, 10, "NONSPECIFIC"), (0, 5, 20, 30, "ALLELE1")], "g long, pid long, l long, r long, gt string")
    ways = spark.createDataFrame([(0, 1, [1, 2, 3, 5]), (0, 2, [1, 4, 3]), (0, 3, [1, 3])], "g long, id long, way array<long>")
    made = {r.id: (r.gt, [(x.l, x.r) for x in r.exons]) for r in rules.transcripts(ways, parts, K, "id").collect()}
    assert made == {1: ("ALLELE2", [(0, 9), (20, 30)]), 2: ("NONSPECIFIC", [(0, 5), (6, 10)]), 3: ("UNPHASED", [(0, 5), (6, 9)])}


def test_balanced_sample_never_deals_all_rows_by_the_group_alone(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("s"), F.col("id").alias("place"))
    sample = paths.balanced_sample(rows, "s", "place", 10)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert sorted((r.s, r.place) for r in sample.collect()) == [(k % 2, k) for k in sorted(range(20), key=lambda k: (k % 2, k))]


def test_surviving_edges_in_tasks_and_by_jobs_are_the_same(spark):
    """Graphs within the bound are not made by rounds of jobs; larger ones still are, with the same edges."""
    rng, vertices, edges = random.Random(23), [], []
    for g in range(30):
        n = rng.randrange(2, 18)
        vertices += [(g, v, *rng.choice([("$", "UNPHASED")] * 4 + [("A", "ALLELE1"), ("T", "ALLELE2"), ("A", "NONSPECIFIC")])) for v in range(1, n + 1)]
        edges += [(g, s, t, rng.choice([0.01, 0.5, 1.55, 1.6, 3.0])) for s in range(n + 1) for t in range(s + 1, n + 2) if rng.random() < (0.25 if t - s < 5 else 0.05)]
    frames = spark.createDataFrame(vertices, "g long, v long, ale string, gt string"), spark.createDataFrame(edges, "g long, s long, t long, w double")

    def surviving(in_task):
        before = spark.sparkContext.parallelize([0]).id()
        got = sorted(map(tuple, rules.surviving_edges(*frames, K, in_task=in_task).collect()))
        return got, spark.sparkContext.parallelize([0]).id() - before

    (own, few), (rounds, many), (mixed, _) = map(surviving, (1 << 16, 0, 40))
    assert own and own == rounds == mixed and few < many / 4
