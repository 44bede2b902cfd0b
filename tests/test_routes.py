"""Parts, classes and halves of vertices against brute force over all sets of their edges' parts."""

import itertools
import random

from test_graphs import K, edges_of

from braidline.operators import routes


def random_vertices(seed, n):
    """Graphs with one vertex (50) that has edges in (from below) and out, and some routes through it."""
    rng, edges, through = random.Random(seed), [], []
    for g in range(n):
        i, o = rng.randrange(1, 7), rng.randrange(1, 7)
        heavy = rng.choice([9, 60, 5000])
        edges += [(g, s, 50, rng.randrange(1, heavy)) for s in range(1, i + 1)] + [(g, 50, 50 + t, rng.randrange(1, heavy)) for t in range(1, o + 1)]
        share = rng.choice([0, 0, 0.1, 0.2, 0.6])
        through += [(g, 50, s, 50 + t) for s in range(1, i + 1) for t in range(1, o + 1) if rng.random() < share]
    return edges, through


def parts_of(ins, outs, through):
    part = {x: {x} for x in [*((False, s) for s in ins), *((True, t) for t in outs)]}
    for s, t in through:
        both = part[False, s] | part[True, t]
        for x in both:
            part[x] = both
    return sorted({tuple(sorted(p)) for p in part.values()})


def plain_class(ins, outs, through):
    parts, n = parts_of(ins, outs, through), len(ins) + len(outs)
    if len(ins) == 1 or len(outs) == 1:
        return "trivial", n, len(parts)
    if not through:
        return "simple", n - 1, len(parts)
    one = any(sum(any(x[0] == out for x in p) for p in parts) == 1 for out in (False, True))
    if len(parts) == 1 or one:
        return "single" if len(parts) == 1 else "multiple", len(through) - n + 2 * len(parts), len(parts)
    return "hyper", len(parts) - 1, len(parts)


def scaled_to(items, top):
    total = sum(n for n, _ in items)
    return sorted((max(1, int(n * (top / total if total else 0))), p) for n, p in items)


def first_subset(items, total):
    """Of the subsets with that sum the one that the order of items gives: its last item is the earliest possible, and so on back."""
    for size in range(len(items) + 1):
        if total in {sum(n for n, _ in c) for k in range(size + 1) for c in itertools.combinations(items[:size], k)}:
            return [] if size == 0 else [items[size - 1][1], *first_subset(items[: size - 1], total - items[size - 1][0])]


def plain_split(ins, outs, through):
    """(imbalance, ins, outs) or None, and the smallest gap between two sums."""
    parts = parts_of(ins, outs, through)
    a, b = sum(ins.values()), sum(outs.values())
    top = max(a, b)
    over = {p: round(sum(outs[x] * -(top / b) if out else ins[x] * (top / a) for out, x in p), 9) for p in parts}
    more, less = ([(int(abs(over[p])), p) for p in parts if (over[p] < 0) == side] for side in (False, True))
    alone = min(((round(int(abs(over[p])) / top, 9), over[p] < 0, p) for p in parts if len(p) > 1), default=None)
    halves = [(alone[0], 0, [alone[2]])] if alone else []
    if len(more) > 1 and len(less) > 1:
        high = min(1000, max(sum(n for n, _ in more), sum(n for n, _ in less)))
        more, less = scaled_to(more, high), scaled_to(less, high)
        sums = [sorted({sum(n for n, _ in c) for k in range(1, len(x)) for c in itertools.combinations(x, k)}) for x in (more, less)]
        gap, _, x, y = min((abs(x - y), min(x, y), x, y) for x in sums[0] for y in sums[1])
        chosen = first_subset(more, x) + first_subset(less, y)
        halves.append((round(abs(sum(over[p] for p in chosen)) / top, 9), 1, chosen))
    if not halves:
        return None
    e, _, chosen = min(halves, key=lambda h: h[:2])
    own = [sorted(x for p in chosen for out, x in p if out == side) for side in (False, True)]
    return (e, *own) if 0 < len(own[0]) < len(ins) and 0 < len(own[1]) < len(outs) else None


def test_classes_and_splits(spark):
    edges, through = random_vertices(11, 400)
    found = spark.createDataFrame(through, "g long, v long, s long, t long")
    legs = routes.legs(edges_of(spark, edges), found, K)
    classes = {r.g: (r["class"], r.degree, r.parts) for r in routes.route_classes(legs, found, K).collect()}
    halves = {r.g: (r.imbalance, r.ins, r.outs) for r in routes.splits(legs, K).collect()}
    kinds = set()
    for g in range(400):
        ins, outs = {s: w for x, s, t, w in edges if x == g and t == 50}, {t: w for x, s, t, w in edges if x == g and s == 50}
        own = [(s, t) for x, _, s, t in through if x == g]
        assert classes[g] == plain_class(ins, outs, own)
        kinds.add(classes[g][0])
        want = plain_split(ins, outs, own)
        assert (want is None) == (g not in halves)
        if want:
            assert abs(halves[g][0] - want[0]) < 2e-9 and halves[g][1:] == want[1:]
    assert kinds == {"trivial", "simple", "single", "multiple", "hyper"} and 100 < len(halves) < 400


def test_routes_of_ways(spark):
    ways = spark.createDataFrame([(0, [1, 2, 3, 4]), (0, [1, 2, 3]), (0, [2, 3]), (0, [])], "g long, way array<long>")
    assert {tuple(r) for r in routes.routes_of_ways(ways, K).collect()} == {(0, 2, 1, 3, 2), (0, 3, 2, 4, 1)}


def test_vertices_at_an_end_have_no_legs(spark):
    found = spark.createDataFrame([], "g long, v long, s long, t long")
    legs = routes.legs(edges_of(spark, [(0, 1, 2, 3), (0, 2, 3, 4)]), found, K)
    assert {(r.v, r.out, r.o) for r in legs.collect()} == {(2, False, 1), (2, True, 3)}
    assert routes.legs(edges_of(spark, []), found, K).count() == 0
