"""Rules on junctions, and the rewriting of splice graphs, against a plain loop over one graph at a time."""

import random

from test_graphs import K, VERTEX, by_graph, edges_of, plain_surviving, vertex

from braidline.operators import revise, rules


def plain_refined(edges, end):
    while True:
        ins, outs = {t for _, t in edges}, {s for s, _ in edges}
        kept = {(s, t): w for (s, t), w in edges.items() if (s == 0 or s in ins) and (t == end or t in outs)}
        if len(kept) == len(edges):
            return kept
        edges = kept


def plain_revised(vertices, edges):
    """One rule after the other, from the first again after each that applied."""
    at = {v: dict(l=l, r=r, ale=ale, gt=gt, weight=weight, dev=dev, empty=empty) for v, l, r, ale, gt, weight, dev, _, _, empty in vertices}
    end = max(at) + 1
    e = {(s, t): w for s, t, w in edges}
    applied = []

    def ins(v):
        return [s for s, t in e if t == v]

    def outs(v):
        return [t for s, t in e if s == v]

    def empty(found):
        new = [v for v in found if not at[v]["empty"]]
        for v in new:
            at[v]["empty"] = True
        return bool(new)

    def one(v):
        return len(ins(v)) == 1 and len(outs(v)) == 1

    def inner():
        return empty([v for v in at if at[v]["ale"] == "$" and at[v]["dev"] < 0.01 and one(v) and (ins(v)[0] == 0 or outs(v)[0] == end)
                      and not (ins(v)[0] != 0 and len(outs(ins(v)[0])) == 1) and not (outs(v)[0] != end and len(ins(outs(v)[0])) == 1)])

    def small_exons():
        return empty([v for v in at if at[v]["r"] - at[v]["l"] < 20 and (ins(v) or outs(v)) and not any(s and at[s]["r"] == at[v]["l"] for s in ins(v))
                      and not any(t != end and at[t]["l"] == at[v]["r"] for t in outs(v)) and (0 in ins(v) or end in outs(v))])

    def introns():
        found = []
        for v in at:
            if one(v) and (s := ins(v)[0]) and (t := outs(v)[0]) != end and at[s]["r"] == at[v]["l"] and at[t]["l"] == at[v]["r"] and (s, t) in e:
                if at[v]["weight"] <= min(2.0, e[s, t]):
                    found.append(v)
        return empty(found)

    def small_junctions():
        gone = set()
        for v in at:
            before, after = [s for s in ins(v) if s], [t for t in outs(v) if t != end]
            left = {s for s in before if at[s]["ale"] == "$" and at[s]["r"] == at[v]["l"]}
            right = {t for t in after if at[t]["ale"] == "$" and at[t]["l"] == at[v]["r"]}
            for beside, others, edge in ((left, before, lambda o: (o, v)), (right, after, lambda o: (v, o))):
                most = max((at[o]["weight"] for o in beside), default=0)
                gone |= {edge(o) for o in others if o not in beside and min(most, at[v]["weight"]) >= 2 * e[edge(o)] ** 2 + 18}
        for x in gone:
            del e[x]
        return bool(gone)

    def extended(to_start):
        new = {}
        for v in at:
            beside = [(s, v) for s in ins(v)] if to_start else [(v, t) for t in outs(v)]
            edge = (0, v) if to_start else (v, end)
            w = sum(e[x] for x in beside)
            if edge not in e and (ins(v) or outs(v)) and at[v]["ale"] == "$" and at[v]["weight"] >= max(w, 10 * w * w + 10):
                new[edge] = at[v]["weight"] - w
        e.update(new)
        return bool(new)

    def weak():
        for s, t in sorted(e):
            if s and t != end and at[t]["l"] > at[s]["r"]:
                bar = 10 * e[s, t] ** 2 + 10
                last, first = len(outs(s)) == 1, len(ins(t)) == 1
                if last and at[s]["weight"] >= bar or first and at[t]["weight"] >= bar:
                    del e[s, t]
                    e.update({(s, end): at[s]["weight"]} if last else {})
                    e.update({(0, t): at[t]["weight"]} if first else {})
                    return True
        return False

    def surviving():
        nonlocal e
        kept = plain_surviving([(v, x["ale"], x["gt"]) for v, x in at.items()], [(*k, w) for k, w in e.items()])
        lost = len(kept) < len(e)
        e = {k: w for k, w in e.items() if k in kept}
        return lost

    e = plain_refined(e, end)
    if surviving():
        e = plain_refined(e, end)
    order = [inner, small_exons, introns, small_junctions, lambda: extended(True), lambda: extended(False), weak, surviving]
    while True:
        for n, rule in enumerate(order):
            if rule():
                applied.append(n)
                e = plain_refined(e, end) if n in (3, 6, 7) else e
                break
        else:
            return {v for v, x in at.items() if x["empty"]}, e, applied


def random_splice_graphs(n, seed=11):
    rng, vertices, edges = random.Random(seed), [], []
    for g in range(n):
        place, size = 0, rng.randrange(1, 12)
        for v in range(1, size + 1):
            place += rng.choice([0, 0, 5, 40])
            l, place = place, place + rng.choice([1, 10, 30])
            ale, gt = ("$", "UNPHASED") if rng.random() < 0.85 else (rng.choice("AT"), rng.choice(["ALLELE1", "ALLELE2", "NONSPECIFIC"]))
            vertices.append((g, v, l, place, ale, gt, rng.choice([0.25, 1.0, 2.0, 12.0, 25.0, 60.0]), rng.choice([0.0, 1.0]), 1, 2, rng.random() < 0.1))
        for s in range(size + 1):
            for t in range(s + 1, size + 2):
                if rng.random() < (0.7 if t == s + 1 else 0.25 if t - s < 5 else 0.1):
                    edges.append((g, s, t, rng.choice([0.25, 0.5, 1.0, 1.5, 1.75, 3.0])))
    return vertices, edges


def test_graphs_are_rewritten_as_by_a_plain_loop(spark):
    vertices, edges = random_splice_graphs(500)
    frames = spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(edges, "g long, s long, t long, w double")
    own, links = revise.revised(*frames, K)
    empty, kept = {(r.g, r.v) for r in own.where("empty").collect()}, {(r.g, r.s, r.t): r.w for r in links.collect()}
    want_empty, want_kept, applied = set(), {}, set()
    lines = by_graph(edges)
    for g, of in by_graph(vertices).items():
        gone, left, steps = plain_revised(of, lines.get(g, []))
        want_empty |= {(g, v) for v in gone}
        want_kept |= {(g, *k): w for k, w in left.items()}
        applied |= set(steps)
    assert applied >= set(range(7)) and own.count() == len(vertices)
    assert empty == want_empty and kept == want_kept


def test_no_graphs(spark):
    own, links = revise.revised(spark.createDataFrame([], VERTEX), spark.createDataFrame([], "g long, s long, t long, w double"), K)
    assert own.count() == 0 and links.count() == 0
    own, links = revise.revised(spark.createDataFrame([vertex(1, 0, 10)], VERTEX), edges_of(spark, []), K)
    assert own.count() == 1 and links.count() == 0


def test_small_junctions(spark):
    # 1 touches 2 and both are heavy: the junction into 2 is dwarfed, and that out of 2, which nothing touches on the right, is not
    vertices = spark.createDataFrame([vertex(3, 0, 10), vertex(1, 50, 60, weight=25.0), vertex(2, 60, 90, weight=25.0), vertex(4, 100, 110, weight=25.0)], VERTEX)
    edges = edges_of(spark, [(0, 1, 2, 1), (0, 3, 2, 1), (0, 2, 4, 1), (0, 0, 2, 1)])
    assert [(r.s, r.t) for r in rules.small_junctions(vertices, edges, K).collect()] == [(3, 2)]


def test_weak_junctions(spark):
    vertices = spark.createDataFrame([vertex(1, 0, 10, weight=20.0), vertex(2, 40, 60, weight=5.0), vertex(3, 60, 90, weight=30.0)], VERTEX)
    edges = edges_of(spark, [(0, 1, 2, 1), (0, 2, 3, 1), (0, 0, 2, 3), (0, 3, 4, 1)])
    assert [tuple(r) for r in rules.weak_junctions(vertices, edges, K).collect()] == [(0, 1, 2, 20.0, None)]
    assert rules.weak_junctions(vertices, edges, K, more=10.5).count() == 0


def test_rounds_of_small_graphs_take_no_job_for_dead_ends_and_surviving_edges(spark):
    """As by rounds of jobs, which larger graphs still take, but with far fewer jobs."""
    line = [(g, v, 100 * v, 100 * v + 100, "$", "UNPHASED", 3.0, 1.0, 0, 0, False) for g in range(3) for v in range(1, 9)]
    edges = [(g, v, v + 1, float(1 + (v + g) % 3)) for g in range(3) for v in range(9)]

    def jobs(in_task):
        before = spark.sparkContext.parallelize([0]).id()
        _, links = revise.revised(spark.createDataFrame(line, VERTEX), spark.createDataFrame(edges, "g long, s long, t long, w double"), K, in_task=in_task)
        got = sorted(map(tuple, links.collect()))
        return got, spark.sparkContext.parallelize([0]).id() - before

    (own, few), (rounds, many) = map(jobs, (1 << 16, 0))
    assert own == rounds and own and few < many / 2
