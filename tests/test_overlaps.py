"""Classes of overlapping intervals against components of all pairs."""

import random

from braidline.operators import overlaps


def plain_classes(rows, n, d):
    top = {x[1]: x[1] for x in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for c, i, l, r, _ in rows:
        for e, j, a, b, _ in rows:
            if c == e and (shared := min(r, b) - max(l, a)) > 0 and d * shared >= n * min(r - l, b - a):
                top[find(i)] = find(j)
    least = {}
    for _, i, l, _, _ in rows:
        least[find(i)] = min(least.get(find(i), l), l)
    return {i: least[find(i)] for _, i, *_ in rows}


def random_rows(seed, n=700, keys=8):
    """Keys of short and long intervals, crowded to different degrees, many of them equal or with an end in common."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = rng.randrange(keys)
        l = rng.randrange(100 * (key + 1) * 2)
        rows.append((key, i, l, l + rng.choice([1, 3, 10, 11, 40, 60, rng.randrange(1, 90)]), float(rng.randrange(9))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, id long, l long, r long, cov double")


def test_overlap_classes(spark):
    for seed, share in ((1, (9, 10)), (2, (9, 10)), (3, (3, 5))):
        rows = random_rows(seed)
        got = {r.id: r["class"] for r in overlaps.overlap_classes(frame(spark, rows), ["k"], "id", share, width=64).collect()}
        assert got == plain_classes(rows, *share) and 2 < len(set(got.values())) < len(rows)


def test_two_that_only_an_inner_one_joins(spark):
    rows = [(0, 1, 0, 100, 1.0), (0, 2, 90, 200, 1.0), (0, 3, 90, 100, 4.0), (0, 4, 300, 310, 1.0), (0, 5, 310, 320, 1.0), (0, 6, 50, 50, 1.0)]
    classes = overlaps.overlap_classes(frame(spark, rows), ["k"], "id", width=16)
    assert {r.id: r["class"] for r in classes.collect()} == {1: 0, 2: 0, 3: 0, 4: 300, 5: 310}
    one = {(r.l, r.r): (r.n, r.cov) for r in overlaps.as_one(classes, ["k"], "class", "cov").collect()}
    assert one == {(0, 200): (3, (100 + 110 + 40) / 220), (300, 310): (1, 1.0), (310, 320): (1, 1.0)}


def test_singles_less_than_the_gap_apart(spark):
    rows = [(0, 1, 0, 10, 1.0), (0, 2, 2, 9, 9.0), (0, 3, 0, 10, 9.0), (0, 4, 109, 119, 3.0), (0, 5, 219, 229, 5.0)]
    got = sorted(tuple(r) for r in overlaps.joined_singles(frame(spark, rows), ["k"], "id", "cov", width=16).collect())
    assert got == [(0, 0, 119, 2, 2.0), (0, 219, 229, 1, 5.0)]
    assert overlaps.joined_singles(frame(spark, []), ["k"], "id", "cov").count() == 0


def test_random_singles_that_lie_in_no_other(spark):
    rows = random_rows(4)
    got = {r.id for r in overlaps.not_contained(frame(spark, rows), ["k"], "id", width=32).collect()}
    assert got == {i for c, i, l, r, _ in rows if not any(c == e and a <= l and b >= r and ((a, b) != (l, r) or j < i) for e, j, a, b, _ in rows)}
