"""Pairs of 64-bit fingerprints within a Hamming budget, by a self-join of their binary trie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, is_empty

#: Fingerprints under a trie node that a task takes on, about; a node with over SPREAD times as many is divided further.
LEAF, SPREAD = 4096, 4
#: Bits by which overfull nodes go deeper.
STEP = 4
#: Node pairs that a task holds at once.
FRONTIER = 1 << 17
#: Ranges of at most so many fingerprint pairs are compared directly.
DIRECT = 16
#: Node pairs compared directly at a time.
AT_ONCE = 1 << 14


def _masks(bits: int, budget: int) -> list[int]:
    """All ways to differ in at most budget of so many bits."""
    out, level = [0], [0]
    for _ in range(min(budget, bits)):
        level = sorted({m | 1 << b for m in level for b in range(bits) if not m >> b & 1})
        out += level
    return out


def reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that the pairs join, each but the least of its component with that least one: as many pairs as values at most."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    more = label != np.arange(len(values))
    return values[label[more]], values[more]


def subtree_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, budget: int, spanning: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget of two subtrees' sorted fingerprints; b None: of one subtree with itself, each pair once.

    The fingerprints of each side share their first depth bits, which differ in used bits between the sides. Node pairs
    go down together, a bit at a time; a node is a range of the sorted array. A pair whose children's bits differ has
    spent one more, and is pruned beyond the budget. With spanning, pairs that join the same values come instead, as of reached().
    """
    same = b is None
    b = a if same else b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(depth, np.array([[0, len(a), 0, len(b), used]], np.int64))]
    ones: dict[tuple[int, int], np.ndarray] = {}

    def ones_before(side: int, bit: int) -> np.ndarray:
        if (side, bit) not in ones:
            x = b if side else a
            ones[side, bit] = np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        return ones[side, bit]

    while stack:
        level, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(level, pairs[:FRONTIER]), (level, pairs[FRONTIER:])]
            continue
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        direct = (sizes <= DIRECT) | (level == 64)
        here = pairs[direct]
        for start in range(0, len(here), AT_ONCE):
            p, k = here[start : start + AT_ONCE], sizes[direct][start : start + AT_ONCE]
            row = np.repeat(np.arange(len(p)), k)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            width = (p[:, 3] - p[:, 2])[row]
            i, j = p[row, 0] + nth // width, p[row, 2] + nth % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            found.append((a[i[near]], b[j[near]]))
            held += len(found[-1][0])
            if spanning and held > FRONTIER:
                found = [reached(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))]
                held = len(found[-1][0]) // 2  # anew when as many have come
        pairs = pairs[~direct]
        if not len(pairs):
            continue
        bit = 63 - level
        ca, cb = ones_before(0, bit), ones_before(0 if same else 1, bit)
        a0, a1, b0, b1, d = pairs.T
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])
        own = (a0 == b0) & (a1 == b1) & same
        kids = [np.stack([a0, am, b0, bm, d], 1), np.stack([am, a1, bm, b1, d], 1)]
        more = d < budget
        kids.append(np.stack([a0, am, bm, b1, d + 1], 1)[more])
        kids.append(np.stack([am, a1, b0, bm, d + 1], 1)[more & ~own])
        pairs = np.concatenate(kids)
        stack.append((level + 1, pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    x, y = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    return reached(x, y) if spanning else (x, y)


def depth_of(n: int, leaf: int) -> int:
    """The depth at which the nodes of a trie of n fingerprints have about leaf of them."""
    return max(0, int(np.ceil(np.log2(max(1, n) / leaf))))


def copies_of(n: int, leaf: int, budget: int) -> int:
    """To how many pairs of nodes trie_links() sends each of n fingerprints at least."""
    return len(_masks(depth_of(n, leaf), budget))


def trie_links(fingerprints: DataFrame, column: str = "fp", budget: int = 2, tag_bits: int = 0, tags: int = 1, leaf: int = LEAF, spanning: bool = False) -> DataFrame:
    """(a, b) of all pairs of different values of the long column that differ in at most budget bits, each once.

    Many tries are one where the first tag_bits name them, tags of them about: those bits have to be equal. With spanning, only as many
    pairs come as join the same components: of a group in which all are linked, not the square of its size.

    The top of the trie is traversed by Spark: every fingerprint goes to each pair of nodes at some depth that its own
    node is part of and that has not spent the budget. The depth follows the number of fingerprints, so that a node has
    about LEAF of them; pairs with a node that still has many more go STEP bits deeper, again and again, so a crowded
    branch is divided and no task takes on an unbounded one. What is below a pair of nodes is traversed in one task.
    Nulls are ignored.
    """
    fps = fingerprints.select(F.col(column).cast("long").alias("fp")).where("fp is not null").distinct()
    spark, schema = fps.sparkSession, "a long, b long"
    fps = cut(fps)
    n = fps.count()
    depth = tag_bits + depth_of(n // tags, leaf)

    def node(x, bits: int):
        return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")

    def deeper(rows: DataFrame, old: int, new: int) -> DataFrame:
        """Rows (fp, other, d) of node pairs at depth old, for all their children at depth new."""
        low = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("c")) for m in _masks(new - max(old, tag_bits), budget)]))
        rows = rows.withColumn("x", low).where(F.col("d") + F.col("x.c") <= budget)
        own_low = node(F.col("fp"), new).bitwiseAND(F.lit((1 << (new - old)) - 1).cast("long"))
        other = F.shiftleft("other", new - old).bitwiseOR(own_low.bitwiseXOR(F.col("x.m")))
        return rows.select("fp", other.alias("other"), (F.col("d") + F.col("x.c")).alias("d"))

    rows = deeper(fps.select("fp", F.lit(0).cast("long").alias("other"), F.lit(0).alias("d")), 0, depth)
    found = None
    while True:
        full = fps.groupBy(node(F.col("fp"), depth).alias("node")).count().where(F.col("count") > leaf * SPREAD).select("node")
        done = depth >= 60 or is_empty(full)
        ready = rows
        if not done:
            full = cut(full)
            marked = rows.withColumn("own", node(F.col("fp"), depth))
            for side in ("own", "other"):
                marked = marked.join(full.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_full")), side, "left")
            marked = cut(marked.select("fp", "other", "d", F.coalesce("own_full", "other_full", F.lit(False)).alias("full")))
            ready, crowded = marked.where("not full"), marked.where("full")
        own = node(F.col("fp"), depth)
        ready = ready.select(F.least(own, "other").alias("ka"), F.greatest(own, "other").alias("kb"), (own > F.col("other")).alias("right"), "d", "fp")
        at = depth

        def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            if pdf["ka"].iat[0] == pdf["kb"].iat[0]:
                x, y = subtree_pairs(np.sort(fp), None, at, 0, budget, spanning)
            else:
                right = pdf["right"].to_numpy()
                x, y = subtree_pairs(np.sort(fp[~right]), np.sort(fp[right]), at, int(pdf["d"].iat[0]), budget, spanning)
            return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

        links = ready.groupBy("ka", "kb").applyInPandas(pairs, schema)
        found = links if found is None else found.union(links)
        if done:
            return found
        rows = deeper(crowded.select("fp", "other", "d"), depth, min(64, depth + STEP))
        depth = min(64, depth + STEP)
