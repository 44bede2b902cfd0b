"""Intervals (keys, id, l, r, ...) that overlap so much that they are taken for one, all found by sorted passes and never by pairs.

Intervals without any length are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, prefix, sessionize

#: The share of the shorter of two intervals that makes them equal, and how near others have to be to be joined.
SHARE, LEAST_GAP = (9, 10), 100


def _with_holder(df: DataFrame, keys: list[str], id_: str, width: int) -> DataFrame:
    """Adds _before, the end and minus the start of the interval that reaches furthest of those before, by start, then the longer first; and _top, whether a row reaches further."""
    df = df.where("l < r").withColumn("_bin", F.floor(F.col("l") / width)).withColumn("_nr", -F.col("r"))
    df = prefix(df, keys, "_bin", ["l", "_nr", id_], F.max, F.struct(F.col("r").alias("r"), (-F.col("l")).alias("nl")), "_before", F.greatest)
    return df.withColumn("_top", F.coalesce(F.col("r") > F.col("_before.r"), F.lit(True)))


def not_contained(df: DataFrame, keys: list[str], id_: str, width: int = BIN) -> DataFrame:
    """The rows that lie in no other; of equal ones that of the least id."""
    return _with_holder(df, keys, id_, width).where("_top").select(*df.columns)


def overlap_classes(df: DataFrame, keys: list[str], id_: str, share: tuple[int, int] = SHARE, width: int = BIN) -> DataFrame:
    """Adds class, the least start of the intervals that a row is one with, directly or by others: two are if they share at least so much (n of d) of the shorter one.

    Rows that lie in no other have ascending starts and ends. Of these only neighbours need be compared: where two that are
    further apart share enough, all neighbours between them do. Two neighbours are one too if a row inside another has
    enough of itself in both; that is so if n of d of it end before the first one's end, and begin after the second one's start,
    for which the largest such start of all rows that end in time is enough. Any other row is one with what it lies in.
    """
    n, d = share
    length = F.col("r") - F.col("l")
    rows = _with_holder(df, keys, id_, width)
    # each neighbour asks at its predecessor's end, each inner row answers at the place where enough of it has passed
    at = F.when(F.col("_top"), d * F.coalesce("_before.r", "l")).otherwise(d * F.col("l") + n * length)
    rows = rows.withColumn("_at", at).withColumn("_at_bin", F.floor(F.col("_at") / (d * width)))
    rows = prefix(rows, keys, "_at_bin", ["_at", "_top"], F.max, F.when(~F.col("_top"), d * F.col("r") - n * length), "_answer", F.greatest)
    direct = d * (F.col("_before.r") - F.col("l")) >= n * F.least(length, F.col("_before.r") + F.col("_before.nl"))
    joined = F.coalesce(direct, F.lit(False)) | F.coalesce(F.col("_before").isNotNull() & (F.col("_answer") >= d * F.col("l")), F.lit(False))
    start = F.when(F.col("_top") & ~joined, F.col("l"))
    return prefix(rows, keys, "_bin", ["l", "_nr", id_], F.max, start, "class", F.greatest, inclusive=True).select(*df.columns, "class")


def as_one(df: DataFrame, keys: list[str], by: str, cov: str) -> DataFrame:
    """(keys, l, r, n, cov): the span of each class, how many it has, and their mean coverage, each weighted by its length."""
    length = F.col("r") - F.col("l")
    mean = F.sum(F.col(cov) * length) / F.sum(length)
    return df.groupBy(*keys, by).agg(F.min("l").alias("_l"), F.max("r").alias("r"), F.count("*").alias("n"), mean.alias("cov")).select(*keys, F.col("_l").alias("l"), "r", "n", "cov")


def joined_singles(df: DataFrame, keys: list[str], id_: str, cov: str, gap: int = LEAST_GAP, width: int = BIN) -> DataFrame:
    """(keys, l, r, n, cov): the rows that lie in no other, those less than gap apart as one."""
    rows = not_contained(df, keys, id_, width)
    return as_one(sessionize(rows, keys, gap=gap - 1, tie=(id_,), width=width), keys, "locus", cov)
