"""Regions of loci, the parts of them that reads cover, the ways of reads through them, and the graph of those.

Positions are half-open. A block or piece has an allele: PLAIN, or what a read has at a known site. Keys name a locus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import gt_conflict
from ..runtime import cut, scratch
from .intervals import coverage, following, in_bins, points_in_intervals, region_stats, sessionize

#: What meets at a position, as bits.
START, END, LEFT, RIGHT, SITE_LEFT, SITE_RIGHT = 1, 2, 4, 8, 16, 32
#: The least length, mean and largest depth of a covered part that touches no splice or site, and the weight of what has none.
LEAST_LENGTH, LEAST_MEAN, LEAST_DEPTH, LEAST_WEIGHT = 15, 1.5, 3, 0.01
PLAIN, UNKNOWN = "$", "N"


def split_by_sites(blocks: DataFrame, sites: DataFrame, seen: DataFrame, keys: list[str], id_: str, width: int) -> DataFrame:
    """(keys, id, l, r, ale): the blocks (keys, id, l, r) of reads, divided at the sites (keys, p) of one base within them.

    A site's piece has the allele that the read was seen to have there (seen: keys, id, p, ale), else UNKNOWN.
    """
    inside = points_in_intervals(sites.select(*keys, "p").distinct(), blocks, keys, width=width).join(seen.select(*keys, id_, "p", "ale"), [*keys, id_, "p"], "left")
    found = inside.groupBy(*keys, id_, "l", "r").agg(F.array_sort(F.collect_set(F.struct("p", F.coalesce("ale", F.lit(UNKNOWN)).alias("ale")))).alias("at"))
    rows = blocks.join(found, [*keys, id_, "l", "r"], "left").withColumn("at", F.coalesce("at", F.array().cast(found.schema["at"].dataType)))
    lefts, rights = F.concat(F.array("l"), F.transform("at", lambda s: s["p"] + 1)), F.concat(F.transform("at", lambda s: s["p"]), F.array("r"))
    plain = F.zip_with(lefts, rights, lambda l, r: F.struct(l.alias("l"), r.alias("r"), F.lit(PLAIN).alias("ale")))
    at_site = F.transform("at", lambda s: F.struct(s["p"].alias("l"), (s["p"] + 1).alias("r"), s["ale"].alias("ale")))
    pieces = F.concat(F.filter(plain, lambda x: x["l"] < x["r"]), at_site)
    return rows.select(*keys, id_, F.explode(pieces).alias("x")).select(*keys, id_, "x.l", "x.r", "x.ale")


def regions(loci: DataFrame, junctions: DataFrame, alleles: DataFrame, pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, l, r, ale, ltype, rtype, n, ave, dev, high): what lies between neighbouring boundaries of each locus.

    Boundaries are the ends of the locus (keys, l, r), of its junctions (keys, a, b) and of its sites; ltype and rtype
    say which meet there. A site has a region for each allele (keys, l, r, ale, n) seen there, with its count as depth.
    The others have the depth of the plain coverage pieces (keys, l, r, depth).
    """
    ends = (("l", START, loci), ("r", END, loci), ("a", LEFT, junctions), ("b", RIGHT, junctions), ("l", SITE_LEFT, alleles), ("r", SITE_RIGHT, alleles))
    at = reduce(DataFrame.union, (df.select(*keys, F.col(c).alias("p"), F.lit(kind).alias("kind")) for c, kind, df in ends))
    at = at.groupBy(*keys, "p").agg(F.bit_or("kind").alias("type")).withColumn("_bin", F.floor(F.col("p") / width))
    between = following(at, keys, "_bin", ["p"], F.struct("p", "type"), "next").where("next is not null")
    between = between.select(*keys, F.col("p").alias("l"), "next.p", F.col("type").alias("ltype"), F.col("next.type").alias("rtype")).withColumnRenamed("p", "r")
    rows = cut(between.join(alleles.select(*keys, "l", "r", "ale", "n"), [*keys, "l", "r"], "left").withColumn("ale", F.coalesce("ale", F.lit(PLAIN))))
    # of a site's regions only the plain one, if no allele was seen, has coverage of its own
    plain = rows.where(F.col("ale") == PLAIN).select(*keys, F.col("l").alias("rl"), F.col("r").alias("rr"))
    stats = region_stats(plain, pieces, keys, width=width).withColumnsRenamed({"rl": "l", "rr": "r"}).withColumn("ale", F.lit(PLAIN))
    rows = rows.join(stats, [*keys, "l", "r", "ale"], "left")
    seen = F.col("n").isNotNull()
    return rows.select(*keys, "l", "r", "ale", "ltype", "rtype", "n", F.when(seen, F.col("n")).otherwise(F.col("ave")).cast("double").alias("ave"), F.when(seen, F.lit(0.01)).otherwise(F.col("dev")).alias("dev"), F.when(seen, F.col("n")).otherwise(F.coalesce("high", F.lit(0))).cast("long").alias("high"))


def partial_exons(found: DataFrame, pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, rl, rr, ale, l, r, ltype, rtype, ave, dev, high, empty): the covered parts of regions.

    A region that is covered throughout, or an allele's, is one part. Else each run of coverage is one, which starts or
    ends inside the region where it does not reach its ends; it is empty if it is short or thin and touches no splice or
    site. Ends of a region at which a read goes on elsewhere get a part of one base if nothing covers them, but not in
    a region without any coverage.
    """
    whole = [F.col(c) for c in ("ave", "dev", "high")]
    alleles = found.where(F.col("ale") != PLAIN).select(*keys, F.col("l").alias("rl"), F.col("r").alias("rr"), "ale", "l", "r", "ltype", "rtype", *whole, F.lit(False).alias("empty"))

    plain = found.where(F.col("ale") == PLAIN).select(*keys, F.col("l").alias("rl"), F.col("r").alias("rr"), "ltype", "rtype")
    inside = in_bins(pieces, "l", "r", width).join(in_bins(plain, "rl", "rr", width), [*keys, "_bin"])
    lo, hi = F.greatest("l", "rl"), F.least("r", "rr")
    inside = inside.where((lo < hi) & (F.floor(lo / width) == F.col("_bin"))).select(*keys, "rl", "rr", "ltype", "rtype", lo.alias("l"), hi.alias("r"))
    by = [*keys, "rl", "rr", "ltype", "rtype"]
    # the keys as one, as they may have the name that sessionize() adds
    with scratch(found.sparkSession) as keep:
        runs = sessionize(inside.select(F.struct(*by).alias("_in"), "l", "r"), ["_in"], gap=0, width=width)
        runs = keep(runs.groupBy("_in", F.col("locus").alias("_l")).agg(F.max("r").alias("r")).select("_in.*", F.col("_l").alias("l"), "r"))
    stats = region_stats(runs.select(*keys, F.col("l").alias("rl"), F.col("r").alias("rr")), pieces, keys, width=width).withColumnsRenamed({"rl": "l", "rr": "r"})
    runs = cut(runs.join(stats, [*keys, "l", "r"]))
    left, right = F.col("l") == F.col("rl"), F.col("r") == F.col("rr")
    has = lambda c, bits: F.col(c).bitwiseAND(F.lit(bits)) > 0
    thin = (F.col("r") - F.col("l") < LEAST_LENGTH) | (F.col("ave") < LEAST_MEAN) | (F.col("high") < LEAST_DEPTH)
    touches = (left & has("ltype", RIGHT | SITE_RIGHT)) | (right & has("rtype", LEFT | SITE_LEFT))
    parts = runs.select(*keys, "rl", "rr", F.lit(PLAIN).alias("ale"), "l", "r", F.when(left, F.col("ltype")).otherwise(START).alias("ltype"), F.when(right, F.col("rtype")).otherwise(END).alias("rtype"), *whole, (thin & ~touches & ~(left & right)).alias("empty"))

    ends = runs.groupBy(*by).agg(F.min("l").alias("first"), F.max("r").alias("last"))
    stub = lambda l, r, ltype, rtype: (l.alias("l"), r.alias("r"), ltype.alias("ltype"), rtype.alias("rtype"), F.lit(LEAST_WEIGHT).alias("ave"), F.lit(1.0).alias("dev"), F.lit(0).cast("long").alias("high"), F.lit(False).alias("empty"))
    key = [*keys, "rl", "rr", F.lit(PLAIN).alias("ale")]
    at_left = ends.where(has("ltype", RIGHT) & (F.col("first") > F.col("rl"))).select(*key, *stub(F.col("rl"), F.col("rl") + 1, F.col("ltype"), F.lit(END)))
    at_right = ends.where(has("rtype", LEFT) & (F.col("last") < F.col("rr"))).select(*key, *stub(F.col("rr") - 1, F.col("rr"), F.lit(START), F.col("rtype")))
    return alleles.unionByName(parts).unionByName(at_left).unionByName(at_right)


def numbered(parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds each locus's numbers, from 1 on, by place and allele."""
    return parts.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("l", "r", "ale")).cast("long"))


def genotyped(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Adds gt: the genotype of the row's allele at its place by the known ones (keys, l, ale, gt), UNPHASED where there is none."""
    return rows.join(known.select(*keys, "l", "ale", "gt"), [*keys, "l", "ale"], "left").withColumn("gt", F.coalesce("gt", F.lit("UNPHASED")))


def ways_of_reads(pieces: DataFrame, found: DataFrame, parts: DataFrame, keys: list[str], id_: str, width: int) -> DataFrame:
    """(keys, id, way): the numbers of the parts (keys, rl, rr, ale, pid) that a read goes through, in order.

    A plain piece (keys, id, l, r, ale) goes through the plain regions that it overlaps, a piece at a site through that
    of its allele; each region stands for all its parts. Reads with a region without parts have no way.
    """
    own = parts.groupBy(*keys, F.col("rl").alias("l"), F.col("rr").alias("r"), "ale").agg(F.array_sort(F.collect_list("pid")).alias("pids"))
    found = found.select(*keys, "l", "r", "ale").join(own, [*keys, "l", "r", "ale"], "left").withColumnsRenamed({"l": "rl", "r": "rr"})
    both = in_bins(pieces, "l", "r", width).join(in_bins(found, "rl", "rr", width), [*keys, "_bin", "ale"])
    lo = F.greatest("l", "rl")
    both = both.where((lo < F.least("r", "rr")) & (F.floor(lo / width) == F.col("_bin")))
    ways = both.groupBy(*keys, id_).agg(F.bool_and(F.col("pids").isNotNull()).alias("whole"), F.array_sort(F.collect_set(F.struct("rl", "rr", "pids"))).alias("x"))
    return ways.where("whole").select(*keys, id_, F.flatten(F.transform("x", lambda x: x["pids"])).alias("way"))


def splice_graph(parts: DataFrame, ways: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of each locus: (keys, v, l, r, ale, gt, weight, dev) and (keys, s, t, w).

    Vertices are the parts (keys, pid, gt, ...), with 0 for the start; the end is one more than the last. Reads' ways (keys,
    way) make an edge of each pair that follow each other, with as many as they are; parts that touch, and are not of
    different alleles, are joined by LEAST_WEIGHT where no read does. A part that starts (or ends) a transcript is joined to the start (end), by as much
    as its depth exceeds its neighbour's where that touches it; so are alleles that nothing else leads to (from).
    """
    vertices = parts.select(*keys, F.col("pid").alias("v"), "l", "r", "ale", "gt", F.greatest("ave", F.lit(LEAST_WEIGHT)).alias("weight"), "dev")
    pair = F.transform(F.slice("way", 1, F.greatest(F.size("way") - 1, F.lit(0))), lambda s, i: F.struct(s.alias("s"), F.col("way")[i + 1].alias("t")))
    threaded = cut(ways.select(*keys, F.explode(pair).alias("e")).groupBy(*keys, "e.s", "e.t").agg(F.count("*").cast("double").alias("w")))
    before, after = (parts.select(*keys, F.col(c).alias("p"), F.col("pid").alias(n), F.col("gt").alias(f"{n}_gt")) for c, n in (("r", "s"), ("l", "t")))
    touching = before.join(after, [*keys, "p"]).where(~gt_conflict(F.col("s_gt"), F.col("t_gt"))).select(*keys, "s", "t")
    inner = threaded.union(cut(touching.join(threaded, [*keys, "s", "t"], "left_anti").select(*keys, "s", "t", F.lit(LEAST_WEIGHT).alias("w"))))

    def bound(side: str, beside: int, end: Column) -> DataFrame:
        """The parts at a side of which a transcript may end, with the weight of the edge there."""
        bit, own, other, vertex = (START, "l", "r", "t") if side == "s" else (END, "r", "l", "s")
        near = parts.select(*keys, (F.col("pid") - beside).alias("pid"), F.col(other).alias("touch"), F.col("ave").alias("beside"))
        led = inner.select(*keys, F.col(vertex).alias("pid")).distinct().withColumn("led", F.lit(True))
        rows = parts.join(near, [*keys, "pid"], "left").join(led, [*keys, "pid"], "left")
        rows = rows.where((F.col("ltype" if side == "s" else "rtype").bitwiseAND(F.lit(bit)) > 0) | ((F.col("ale") != PLAIN) & F.col("led").isNull()))
        weight = F.greatest(F.col("ave") - F.when(F.col("touch") == F.col(own), F.col("beside")).otherwise(0.0), F.lit(LEAST_WEIGHT))
        rows = rows.withColumn("w", F.coalesce(weight, F.col("ave")))
        return rows.select(*keys, *((end.alias("s"), F.col("pid").alias("t")) if side == "s" else (F.col("pid").alias("s"), end.alias("t"))), "w")

    last = parts.groupBy(*keys).agg((F.max("pid") + 1).alias("_last"))
    starts = bound("s", -1, F.lit(0).cast("long"))
    ends = bound("t", 1, F.lit(-1).cast("long")).join(last, keys).withColumn("t", F.col("_last")).drop("_last")
    return vertices, inner.unionByName(starts).unionByName(ends.select(*keys, "s", "t", "w"))


def depth_of(pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, l, r, depth) of the plain pieces of reads."""
    return coverage(pieces.where(F.col("ale") == PLAIN), keys, width=width)
