"""Overlapping ways of mates against a plain version."""

import random

from braidline.operators import paths


def plain_joined(a, b, ex1, ex2):
    a, b = a[: max(len(a) - ex1, 0)], b[ex2:]
    if not a or a[-1] not in b:
        return None
    i, j = len(a) - 1, b.index(a[-1])
    rest = b[j + 1 :]
    while i >= 0 and j >= 0:
        if a[i] != b[j]:
            return None
        i, j = i - 1, j - 1
    return a + rest


def test_joined_mates(spark):
    rng, rows = random.Random(5), []
    way = lambda: sorted(rng.sample(range(1, 7), rng.randrange(0, 6)))
    rows = [(i, way(), way()) for i in range(2000)] + [(2000, None, [1]), (2001, [1], None)]
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>")
    for ex1, ex2 in ((0, 0), (1, 0), (0, 1), (2, 2)):
        got = {r.id: r.way for r in paths.joined_mates(df, "a", "b", "way", ex1, ex2).collect()}
        want = {i: None if a is None or b is None else plain_joined(a, b, ex1, ex2) for i, a, b in rows}
        assert got == want and sum(w is not None for w in want.values()) > 50
