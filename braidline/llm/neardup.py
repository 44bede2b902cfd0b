"""Near-duplicates by likeness: a trie self-join of SimHash fingerprints proposes pairs, the five-word shingle sets themselves decide."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import cut, is_empty
from .simhash import SEED, first_of_each, smallest_reached
from .skew import with_groups
from .trie import copies_of, trie_links

SHINGLE = 5
#: Linked are texts with a likeness (Jaccard, of shingle sets) of at least LIKE of OUT_OF.
LIKE, OUT_OF = 4, 5
#: A fingerprint has blocks; texts are compared whose fingerprints differ in at most BUDGET bits of a block. At the least likeness a pair is MISSED with this probability.
BUDGET, MISSED = 2, 0.0023
#: The share of bits in which fingerprints of the least likeness differ: by the angle between sets of equal sizes, and a little more, as for small ones.
DIFFER = acos(2 * LIKE / (LIKE + OUT_OF)) / pi + 0.004
#: Bits of the number of a block, and the most that a block has.
TAG_BITS, MOST_BITS = 8, 40
#: Fingerprints of a block under a trie node that a task takes on, about; copies of all its blocks that a fingerprint has in a round at most.
LEAF, COPIES = 1 << 18, 256
#: Buckets of at most so many texts are compared pair by pair; in larger ones each text meets a head first.
ALL_PAIRS = 16
#: Sizes of a class differ by less than this factor.
CLASS = 1.05
#: Shingle hashes counted at a time, in bytes.
AT_ONCE = 240
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 1 << TAG_BITS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; of fewer words than a shingle, one of them all. Words as for simhash()."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """Equal sets have equal nodes: a 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def blocks_for(n: int) -> tuple[int, int]:
    """(bits, blocks) for n texts: blocks so long that few of unlike texts are near, and as many as keep what is missed at MISSED."""
    bits = min(MOST_BITS, max(16, ceil(log2(max(2, n))) + 14))
    near = sum(comb(bits, i) * DIFFER**i * (1 - DIFFER) ** (bits - i) for i in range(BUDGET + 1))
    return bits, ceil(log(MISSED) / log(1 - near))


def blocks_of(shingles: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """The SimHash fingerprint of a set, in blocks: a bit is 1 if set in over half the hashes. A block's number is in its first TAG_BITS, its bits follow.

    A block has hashes of its own, the first bits of the shingles' multiplied by an odd number.
    """
    size = (bits + 7) // 8
    counts = np.zeros((blocks, size * 8), np.int64)
    for i in range(0, len(shingles), AT_ONCE):
        h = (shingles[i : i + AT_ONCE, None] * _FACTORS[:blocks]).astype(">u8").view(np.uint8).reshape(-1, blocks, 8)[:, :, :size]
        counts += np.add.reduce(np.unpackbits(h.reshape(-1, blocks * size), axis=1), 0, np.uint8).reshape(blocks, -1)
    packed = np.zeros((blocks, 8), np.uint8)
    packed[:, 0] = np.arange(blocks)
    ones = counts * 2 > len(shingles)
    ones[:, bits:] = False
    packed[:, 1 : size + 1] = np.packbits(ones, axis=1)
    return packed.view(">i8")[:, 0]


def _sketches(bits: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, fingerprints = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py() or "")
                nodes.append(node_of(s))
                sizes.append(len(s))
                fingerprints.append(blocks_of(s, bits, blocks).astype(np.int64))
            flat = pa.array(np.concatenate(fingerprints) if fingerprints else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * blocks, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "node", "size", "blocks"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(t.as_py() or "")
            if node_of(s) == node:  # else another row with the same id
                nodes.append(node)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both * OUT_OF >= LIKE * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), node))], names=["shingle", "node"])


def sets_of(own: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes. own: doc_id, text; nodes: node, least (a doc_id that has it)."""
    wanted = wanted.select("node").distinct().join(nodes.select("node", F.col("least").alias("doc_id")), "node")
    sets = own.join(wanted, "doc_id").select("node", "text").mapInArrow(_sets, "node long, shingles binary")
    return cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))


def alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets (node, shingles) have the likeness."""
    pairs = pairs.select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"))


def _possible(size_a: str, met_a: str, size_b: str, met_b: str):
    """Whether sets of these sizes can have the likeness; of each set only met elements are in any other set."""
    return F.least(met_a, met_b) * (LIKE + OUT_OF) >= (F.col(size_a) + F.col(size_b)) * LIKE


def small_bucket_links(own: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links among the nodes of each bucket: of at most ALL_PAIRS nodes, all pairs are compared."""
    few = entries.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "size"))).alias("xs"))
    each = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["size"].alias("n_a"), y["size"].alias("n_b")))))
    pairs = few.select(F.explode(each).alias("x")).select("x.*")
    pairs = cut(pairs.where(_possible("n_a", "n_a", "n_b", "n_b")).select("a", "b").distinct())
    return alike(sets_of(own, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes), pairs)


def _class(size):
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(CLASS))).cast("int")


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, extra = [], []
        for x, y in zip(batch.column("shingles"), batch.column("hub_shingles"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            in_hub = np.isin(x, y, assume_unique=True)
            shared.append(int(in_hub.sum()))
            extra.append(x[~in_hub].view(np.int64))
        columns = [batch.column(c) for c in _MEMBER]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(shared, pa.int64()), pa.array(extra, pa.list_(pa.int64()))], names=[*_MEMBER, "shared", "extra"])


_MEMBER = ("hub", "node", "size", "met", "component", "out")


def rarest(members: DataFrame) -> DataFrame:
    """members (hub, node, size, shared, extra, ...) with rare, how many extra shingles other members of the hub have too, and first, the rarest of these, in place of extra.

    Sets of the likeness have LIKE / OUT_OF of the larger in common, and of that each has no more in the hub than it shares
    with it; what is still needed they have in extra. Of so many common elements the rarest is among the first of either
    set, in one order for all: as many as extra has, less what is needed but one. Elements of one set alone are rarer than all.
    """
    each = members.select("hub", "node", F.explode("extra").alias("shingle"))
    known = each.join(each.groupBy("hub", "shingle").agg(F.count("*").alias("n")).where("n > 1"), ["hub", "shingle"])
    known = known.groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("known"))
    needed = F.greatest(F.ceil(F.col("size") * LIKE / OUT_OF) - F.col("shared"), F.lit(1))
    rare = F.coalesce(F.array_size("known"), F.lit(0))
    first = F.slice("known.shingle", F.lit(1), F.greatest(rare - needed + 1, F.lit(0)).cast("int"))
    return cut(members.join(known, ["hub", "node"], "left").select(*_MEMBER, "shared", rare.alias("rare"), first.alias("first")))


def crowded_links(own: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links among the nodes of crowded buckets (key, node, size), enough of them for the same components as all.

    A shingle that only one of these nodes has can be in no intersection; a set with many such shingles can be like no
    other, and is left out. A bucket's head is the node whose shingles most nodes have, for its size, near the text that a
    group's copies were made from. All nodes meet it. Then each bucket has a hub, of its largest component, and what is left are
    the nodes outside that component. Two sets that share nothing besides what the hub has share no more than either has
    in common with the hub; so an outside node is compared with the nodes of other components that share one of the
    rarest shingles with it that the hub has not (see rarest()), and, by classes of sizes, with those with which the hub's part alone could be enough.
    """
    sets = sets_of(own, entries, nodes)
    each = sets.mapInArrow(_each, "shingle long, node long")
    weights = each.join(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingle").groupBy("node").agg(F.count("*").alias("met"), F.sum("n").alias("weight"))
    # a set like any other has enough met elements to be like one of LIKE / OUT_OF its size
    hopeful = cut(entries.join(weights, "node").where(F.col("met") * OUT_OF >= F.col("size") * LIKE).select("key", "node", "size", "met", (F.col("weight") / F.sqrt("size")).cast("float").alias("central")))
    best = F.struct("central", "node")

    heads = hopeful.groupBy("key").agg(F.max_by(F.struct("node", "size", "met"), best).alias("head"))
    heads = heads.select("key", *(F.col(f"head.{c}").alias(f"h_{c}") for c in ("node", "size", "met")))
    both = hopeful.join(heads, "key").where(F.col("node") != F.col("h_node")).where(_possible("size", "met", "h_size", "h_met"))
    found = alike(sets, both.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")))

    labelled = cut(hopeful.join(connected_components(found, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    hubs = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.max_by("node", best).alias("hub")).groupBy("key").agg(F.max_by(F.struct("component", "hub"), F.struct("n", "component")).alias("most"))
    members = labelled.join(hubs, "key").groupBy(F.col("most.hub").alias("hub"), "node").agg(F.min("size").alias("size"), F.min("met").alias("met"), F.min("component").alias("component"), F.bool_or(F.col("component") != F.col("most.component")).alias("out"))
    if is_empty(members.where("out")):
        return found
    members = members.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    members = rarest(cut(members.mapInArrow(_against, "hub long, node long, size long, met long, component long, out boolean, shared long, extra array<long>")))
    outside = members.where("out").select("hub", *(F.col(c).alias(x) for c, x in zip(("node", "size", "met", "component", "shared", "rare", "first"), ("x", "x_size", "x_met", "x_component", "x_shared", "x_rare", "x_first"), strict=True)))
    other = (F.col("component") != F.col("x_component")) & _possible("size", "met", "x_size", "x_met")
    enough = (F.least("shared", "x_shared") + F.least("rare", "x_rare")) * (LIKE + OUT_OF) >= (F.col("size") + F.col("x_size")) * LIKE
    columns = (F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
    by_extra = members.withColumn("shingle", F.explode("first")).join(outside.withColumn("shingle", F.explode("x_first")), ["hub", "shingle"]).where(other & enough).select(*columns)
    # the sizes between which partners lie with which the hub's part is enough
    low, high = F.ceil(F.col("x_size") * LIKE / OUT_OF), F.floor(F.col("x_shared") * (LIKE + OUT_OF) / LIKE) - F.col("x_size")
    classed = outside.where(low <= high).withColumn("class", F.explode(F.sequence(_class(low), _class(high))))
    by_hub = members.withColumn("class", _class(F.col("size"))).join(classed, ["hub", "class"]).where(other & _possible("size", "shared", "x_size", "x_shared")).select(*columns)
    return found.union(alike(sets, by_extra.union(by_hub)))


def bucketed(sketches: DataFrame, n: int, blocks: int) -> DataFrame:
    """(key, node, size): nodes with a block in one component of blocks within the budget have a key in common. sketches: node, size, blocks of n rows.

    The trie self-join runs over all blocks' tries at once, or in rounds, so that its copies do not fill the disks.
    """
    entries = sketches.select("node", "size", F.explode("blocks").alias("block"))
    number = F.shiftrightunsigned("block", 64 - TAG_BITS)
    a_round = max(1, COPIES // copies_of(n, LEAF, BUDGET))
    links = []
    for first in range(0, blocks, a_round):
        some = entries.where(number.between(first, first + a_round - 1)).select("block") if a_round < blocks else entries
        links.append(cut(trie_links(some, "block", BUDGET, TAG_BITS, min(a_round, blocks), LEAF, spanning=True)))
    joined = connected_components(reduce(DataFrame.union, links), "a", "b").withColumnRenamed("node", "block")
    return entries.join(joined, "block", "left").select(F.coalesce("component", "block").alias("key"), "node", "size").distinct()


def likeness_links(own: DataFrame, sketches: DataFrame, nodes: DataFrame, n: int, blocks: int) -> DataFrame:
    """(a, b) of nodes of the likeness that share a bucket, enough of them for the same components as all. own: doc_id, text; sketches: node, size, blocks, a row for each of n nodes; nodes: node, least.

    See bucketed() for buckets. Of small ones all pairs are compared. A crowded one, as a large group of
    near copies makes, would have pairs by the square of its size; see crowded_links().
    """
    entries = bucketed(sketches, n, blocks)
    entries = cut(entries.join(entries.groupBy("key").count().where("count > 1"), "key"))
    found = small_bucket_links(own, entries.where(F.col("count") <= ALL_PAIRS), nodes)
    crowded = cut(entries.where(F.col("count") > ALL_PAIRS).select("key", "node", "size"))
    return found if is_empty(crowded) else found.union(crowded_links(own, crowded, nodes))


def likeness_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every row with an id: the smallest doc_id that links of the likeness reach, the row's own included.

    Texts with equal shingle sets are one node, in a group of any size; texts without words (and nulls) are equal.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    bits, blocks = blocks_for(docs.count())
    sketches = cut(own.mapInArrow(_sketches(bits, blocks), "doc_id long, node long, size long, blocks array<long>"))
    nodes = cut(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    distinct = cut(sketches.groupBy("node").agg(F.first("size").alias("size"), F.first("blocks").alias("blocks")))
    labels = smallest_reached(nodes, "node", likeness_links(own, distinct, nodes, distinct.count(), blocks))
    return with_groups(sketches.select("doc_id", "node"), labels, "node", ["doc_id"], sketches.count()).select("doc_id", "component_id")


def one_of_each_likeness_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group that with the smallest id stays, once. Rows with null ids stay.

    Null texts and texts without words are equal, and so one group. See first_of_each() for ties and columns.
    """
    return first_of_each(docs, likeness_groups(docs, id_col, text_col), id_col, text_col)
