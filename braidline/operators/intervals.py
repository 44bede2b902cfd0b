"""Operators on half-open intervals (l, r) within a key, such as a chromosome and strand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Width of the bins into which a key's positions are divided, so that no task holds a whole key.
BIN = 1 << 16


def prefix(df: DataFrame, keys: list[str], bin_: str, order: list[str], agg: Callable[[Column], Column], value: Column, out: str, combine: Callable[[Column, Column], Column], inclusive: bool = False) -> DataFrame:
    """Adds agg(value) over all rows of the key before each row (and the row's own with inclusive), in order; bins must ascend with the order.

    Each bin is scanned on its own; what the bins before it come to is carried over from a table of bins. So a key with
    a third of all rows is divided among as many tasks as it has bins. df is written once, and not made again for the bins.
    """
    df = cut(df)
    rows = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, bin_).agg(agg(value).alias("_total")).withColumn("_carried", agg(F.col("_total")).over(before)).select(*keys, bin_, "_carried")
    df = df.join(carried, [*keys, bin_]).withColumn("_local", agg(value).over(rows))
    either = F.when(F.col("_local").isNull(), F.col("_carried")).when(F.col("_carried").isNull(), F.col("_local")).otherwise(combine(F.col("_local"), F.col("_carried")))
    return df.withColumn(out, either).drop("_local", "_carried")


def following(df: DataFrame, keys: list[str], bin_: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds value of the next row of the key, in order: of the same bin, else the first of the next bin that has any. df is written once."""
    df = cut(df)
    first = df.groupBy(*keys, bin_).agg(F.min_by(value, F.struct(*order)).alias("_first")).withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy(bin_))).drop("_first")
    here = F.lead(value).over(Window.partitionBy(*keys, bin_).orderBy(*order))
    return df.join(first, [*keys, bin_]).withColumn(out, F.coalesce(here, "_after")).drop("_after")


def sessionize(df: DataFrame, keys: list[str], l: str = "l", r: str = "r", gap: int = 100, tie: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Adds locus: the start of the run of intervals that a row is part of. A new one begins where l exceeds the largest r so far by more than gap."""
    order = [l, r, *tie]
    df = df.withColumn("_bin", F.floor(F.col(l) / width))
    df = prefix(df, keys, "_bin", order, F.max, F.col(r), "_reach", F.greatest)
    start = F.when(F.col("_reach").isNull() | (F.col(l) > F.col("_reach") + gap), F.col(l))
    return prefix(df, keys, "_bin", order, F.max, start, "locus", F.greatest, inclusive=True).drop("_bin", "_reach")


def coverage(df: DataFrame, keys: list[str], l: str = "l", r: str = "r", width: int = BIN) -> DataFrame:
    """(keys, l, r, depth): the pieces between neighbouring ends at which some interval stands, with how many do."""
    ends = df.where(F.col(l) < F.col(r)).select(*keys, F.explode(F.array(F.struct(F.col(l).alias("p"), F.lit(1).cast("long").alias("d")), F.struct(F.col(r).alias("p"), F.lit(-1).cast("long").alias("d")))).alias("e")).select(*keys, "e.p", "e.d")
    steps = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d")).withColumn("_bin", F.floor(F.col("p") / width))
    steps = prefix(steps, keys, "_bin", ["p"], F.sum, F.col("d"), "depth", lambda a, b: a + b, inclusive=True)
    steps = following(steps, keys, "_bin", ["p"], F.col("p"), "r")
    return steps.where("depth > 0").select(*keys, F.col("p").alias("l"), "r", "depth")


def coalesced(df: DataFrame, keys: list[str], l: str = "l", r: str = "r", gap: int = 0, width: int = BIN) -> DataFrame:
    """(keys, l, r, n): the runs of intervals no more than gap apart."""
    return sessionize(df, keys, l, r, gap, width=width).groupBy(*keys, "locus").agg(F.max(r).alias("r"), F.count("*").alias("n")).select(*keys, F.col("locus").alias("l"), "r", "n")


def in_bins(df: DataFrame, l: str, r: str, width: int) -> DataFrame:
    """A row for each bin that [l, r) touches."""
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(l) / width), F.floor((F.greatest(F.col(r) - 1, F.col(l))) / width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], p: str = "p", l: str = "l", r: str = "r", width: int = BIN, how: str = "inner") -> DataFrame:
    """points joined with the intervals of the same key that hold them: an equi-join on key and bin, with the range as the rest."""
    spread = in_bins(intervals, l, r, width)
    return points.withColumn("_bin", F.floor(F.col(p) / width)).join(spread, [*keys, "_bin"], how).where((F.col(l) <= F.col(p)) & (F.col(p) < F.col(r))).drop("_bin")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], width: int = BIN) -> DataFrame:
    """left with the values of the latest right row of the key at or before it: one sorted pass over the union, binned; of equal places the right row with the largest values counts."""
    both = left.withColumn("_right", F.lit(None).cast(f"struct<{','.join(f'{v}:{dict(right.dtypes)[v]}' for v in [at, *values])}>")).unionByName(right.select(*keys, at, F.struct(at, *values).alias("_right")), allowMissingColumns=True)
    both = both.withColumn("_bin", F.floor(F.col(at) / width)).withColumn("_side", F.col("_right").isNull())
    both = prefix(both, keys, "_bin", [at, "_side"], F.max, F.col("_right"), "_last", F.greatest, inclusive=True)
    return both.where("_side").select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def region_stats(regions: DataFrame, pieces: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """regions (keys, rl, rr) with ave, dev and high: length-weighted mean depth over the region, spread over covered pieces only but divided by the full length, and largest depth; 0, 1 and null where nothing covers it."""
    part = in_bins(pieces, "l", "r", width).join(in_bins(regions, "rl", "rr", width), [*keys, "_bin"])
    # each overlap once: in the bin in which it starts
    lo, hi = F.greatest("l", "rl"), F.least("r", "rr")
    part = part.where((lo < hi) & (F.floor(lo / width) == F.col("_bin"))).withColumn("n", hi - lo)
    length = F.col("rr") - F.col("rl")
    sums = part.groupBy(*keys, "rl", "rr").agg(F.sum(F.col("depth") * F.col("n")).alias("s1"), F.sum(F.col("depth") * F.col("depth") * F.col("n")).alias("s2"), F.sum("n").alias("covered"), F.max("depth").alias("high"))
    ave = F.coalesce(F.col("s1") / length, F.lit(0.0))
    var = (F.col("s2") - 2 * ave * F.col("s1") + ave * ave * F.col("covered")) / length
    return regions.join(sums, [*keys, "rl", "rr"], "left").select(*keys, "rl", "rr", ave.alias("ave"), F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(1.0)).alias("dev"), "high")


def not_nesting(df: DataFrame, gaps: DataFrame, keys: list[str], id_: str, cov: str, width: int = BIN) -> DataFrame:
    """Rows of df (keys, id, l, r, cov) without those that have another row of at least their coverage strictly inside one of their gaps (keys, id, gl, gr)."""
    df = cut(df)
    inner = df.select(*keys, F.col(id_).alias("_inner"), F.col("l").alias("_l"), F.col("r").alias("_r"), F.col(cov).alias("_cov")).withColumn("_bin", F.floor(F.col("_l") / width))
    # a gap looks only into bins that hold enough coverage and an end before its own
    bins = inner.groupBy(*keys, "_bin").agg(F.max("_cov").alias("_top"), F.min("_r").alias("_first"))
    own = in_bins(gaps.join(df.select(*keys, id_, cov), [*keys, id_]), "gl", "gr", width)
    own = own.join(bins, [*keys, "_bin"]).where((F.col("_top") >= F.col(cov)) & (F.col("_first") < F.col("gr"))).drop("_top", "_first")
    nests = own.join(inner, [*keys, "_bin"]).where((F.col("_inner") != F.col(id_)) & (F.col("gl") < F.col("_l")) & (F.col("_r") < F.col("gr")) & (F.col("_cov") >= F.col(cov)))
    return df.join(nests.select(*keys, id_).distinct(), [*keys, id_], "left_anti")
