"""Graphs divided between two alleles, against a plain version that takes one vertex after the other."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from test_graphs import K, by_graph
from test_revise import plain_refined

from braidline.operators import graph, phases

VERTEX = "g long, v long, ale string, gt string, weight double"


def random_graphs(seed, n):
    rng, vertices, edges = random.Random(seed), [], []
    for g in range(n):
        size = rng.randrange(2, 25)
        kinds = [("$", "UNPHASED")] * 8 + [("A", "ALLELE1"), ("T", "ALLELE2"), ("A", "NONSPECIFIC")]
        if g % 7 == 0:
            kinds = kinds[:8]
        vertices += [(g, v, *rng.choice(kinds), float(rng.randrange(1, 9))) for v in range(1, size + 1)]
        edges += [(g, s, t, rng.choice([0.01, 0.5, 1.0, 2.0, 5.0])) for s in range(size + 1) for t in range(s + 1, size + 2) if rng.random() < (0.4 if t - s < 3 else 0.05)]
    return vertices, edges


def ratio(a, b):
    return (a + 0.01) / (a + b + 0.02)


def plain_shares(vertices, edges, most=1000):
    """({v: (w1, w2)}, {(s, t): (w1, w2)}), or None."""
    gt, w = {v: g for v, _, g, _ in vertices}, {(s, t): x for s, t, x in edges}
    at = {v: [e for e in w if v in e] for v in gt}
    share, whole, of = {}, [0, 0], {}
    for v in sorted(gt):
        for k, allele in enumerate(("ALLELE1", "ALLELE2")):
            if gt[v] == allele:
                of[v] = 1.0 - k
                whole[k] += sum(w[e] for e in at[v])
                share |= {e: 1.0 - k for e in at[v]}
    if sum(whole) < 0.01:
        return None
    whole = ratio(*whole)

    def own(v):
        a = [(w[e] * share[e], w[e] * (1 - share[e])) for e in at[v] if e in share]
        return ratio(sum(x for x, _ in a), sum(y for _, y in a)) if sum(x + y for x, y in a) > 0 else None

    todo = {v for v, ale, g, _ in vertices if ale == "$" and at[v]}
    waves = 0
    while sum(bool(at[v]) for v in gt) < most:
        wave = sorted(((round(max(r, 1 - r), 9), v) for v in todo if (r := own(v)) is not None), reverse=True)
        waves += 1
        for _, v in wave:
            of[v] = own(v)
            share |= {e: of[v] for e in at[v] if e not in share}
            todo.remove(v)
        if not wave:
            break
    weight = {v: x for v, _, _, x in vertices}
    return {v: (weight[v] * of.get(v, whole), weight[v] * (1 - of.get(v, whole))) for v in gt}, {e: (w[e] * share.get(e, whole), w[e] * (1 - share.get(e, whole))) for e in w}


def test_shares_graphs_and_ways(spark):
    vertices, edges = random_graphs(5, 60)
    rng, ways = random.Random(1), []
    for g, s, t, _ in edges:
        after = [x for h, a, x, _ in edges if h == g and a == t]
        ways.append((g, [s, t, rng.choice(after)] if after and rng.random() < 0.7 else [s, t, 99] if rng.random() < 0.2 else [s, t], rng.randrange(1, 9)))
    frames = spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(edges, "g long, s long, t long, w double")
    of_vertices, of_edges = phases.allele_shares(frames[0].withColumn("r", F.lit(1)).withColumn("m", F.lit(1)), frames[1], K)  # further columns do no harm
    got_v, got_e = {(r.g, r.v): (r.w1, r.w2) for r in of_vertices.collect()}, {(r.g, r.s, r.t): (r.w1, r.w2) for r in of_edges.collect()}
    graphs, kept = defaultdict(dict), {(r.g, r.allele, tuple(r.way)): r.n for r in phases.allele_ways(spark.createDataFrame(ways, "g long, way array<long>, n long"), of_edges, K).collect()}
    for r in phases.allele_graphs(frames[0], of_edges, K).collect():
        graphs[r.g, r.allele][r.s, r.t] = r.w
    own_v, own_e, undivided = by_graph(vertices), by_graph(edges), 0
    want_ways = defaultdict(int)
    for g in own_e:
        want = plain_shares(own_v[g], own_e[g])
        undivided += want is None
        for v, *_ in own_v[g]:
            assert got_v[g, v] == (None, None) if want is None else all(abs(x - y) < 1e-9 for x, y in zip(got_v[g, v], want[0][v], strict=True))
        for s, t, _ in own_e[g]:
            assert got_e[g, s, t] == (None, None) if want is None else all(abs(x - y) < 1e-9 for x, y in zip(got_e[g, s, t], want[1][s, t], strict=True))
        for k, allele in enumerate(("ALLELE1", "ALLELE2")):
            left = {} if want is None else {e: x[k] for e, x in want[1].items() if x[k] >= 0.01}
            assert set(graphs[g, allele]) == set(plain_refined(left, max(v[0] for v in own_v[g]) + 1))
            for h, way, n in ways:
                if h == g and want and all(e in want[1] for e in zip(way, way[1:], strict=False)):
                    want_ways[g, allele, tuple(way)] = max(want_ways[g, allele, tuple(way)], int(min([n, *(want[1][e][k] for e in zip(way, way[1:], strict=False))])))
    assert undivided and kept == {k: n for k, n in want_ways.items() if n} and kept


def test_large_graphs_have_one_ratio(spark):
    vertices = spark.createDataFrame([(0, 1, "A", "ALLELE1", 1.0), (0, 2, "$", "UNPHASED", 1.0), (0, 3, "T", "ALLELE2", 1.0)], VERTEX)
    edges = spark.createDataFrame([(0, 0, 1, 3.0), (0, 1, 2, 3.0), (0, 0, 3, 2.0), (0, 2, 4, 1.0)], "g long, s long, t long, w double")
    near, far = ({(r.s, r.t): r.w1 for r in phases.allele_shares(vertices, edges, K, most)[1].collect()} for most in (1000, 3))
    assert abs(near[2, 4] - 3.01 / 3.02) < 1e-9 and abs(far[2, 4] - 6.01 / 8.02) < 1e-9


def test_waves_in_tasks_and_by_jobs_are_the_same(spark):
    """Graphs within the bound take no job a round; larger ones still go by rounds of jobs, with the same shares."""
    vertices, edges = random_graphs(8, 40)
    frames = spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(edges, "g long, s long, t long, w double")

    def shares(in_task):
        before = spark.sparkContext.parallelize([0]).id()
        got = {(r.g, r.s, r.t): r.w1 for r in phases.allele_shares(*frames, K, in_task=in_task)[1].collect()}
        return got, spark.sparkContext.parallelize([0]).id() - before

    (own, few), (rounds, many), (mixed, _) = map(shares, (1 << 16, 0, 30))
    assert len(own) == len(edges) and few < many / 2
    for other in (rounds, mixed):
        assert own.keys() == other.keys() and all((own[e] is None and x is None) or abs(own[e] - x) < 1e-9 for e, x in other.items())


def test_dead_ends_in_tasks_and_by_jobs_are_the_same(spark):
    _, edges = random_graphs(9, 40)
    frame = spark.createDataFrame([(g, s, t, w, str(w)) for g, s, t, w in edges] + [(99, 0, None, 1.0, "x")], "g long, s long, t long, w double, more string")
    got = [sorted(map(tuple, graph.prune_dead_ends(frame, 0, 9, K, most).collect())) for most in (1 << 16, 0, 30)]
    assert got[0] and got[0] == got[1] == got[2]
