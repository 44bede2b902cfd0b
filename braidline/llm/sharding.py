"""Sharding by sampled splitters: ranges of a text's hash of near equal bytes, overfull ones divided again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

SHARDS = 8
#: Fine ranges by shard at least, rows of a fine range about, fine ranges at most (all that passes through the driver goes by their number; a range of any size is sorted in one task, which spills), sampled keys by range about.
RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES, SAMPLES_PER_RANGE = 64, 100_000, 8192, 24
#: Groups of equal texts of at most this share of a shard's bytes are kept together.
WHOLE_GROUP = 0.01


def _splitters(keys: DataFrame, ranges: int) -> pd.DataFrame:
    """(h, doc_id): where ranges begin. Quantiles of a sample of keys, drawn in proportion to size and, as much again, by row.

    The sample's size is set by the number of ranges alone. A hash that many quantiles fall on, a large group of equal
    texts, is divided by doc_id; any other is not divided.
    """
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return pd.DataFrame({"h": [], "doc_id": []}, dtype="int64")
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.lit(wanted / 2) * (F.col("size") / F.lit(float(total)) + F.lit(1.0 / n))
    drawn = (F.xxhash64("h", "id", F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < chance
    # a row whose chance exceeds 1 counts as often as it exceeds it
    sample = keys.where(drawn).select("h", F.col("id").alias("doc_id"), F.greatest(F.lit(1), F.floor(chance)).cast("int").alias("times")).toPandas()
    sample = sample.loc[sample.index.repeat(sample["times"])].sort_values(["h", "doc_id"], ignore_index=True)
    at = np.unique((np.arange(1, ranges) * len(sample)) // ranges)
    cuts = sample.iloc[at[at < len(sample)]][["h", "doc_id"]].drop_duplicates().reset_index(drop=True)
    first = ~cuts["h"].duplicated()
    cuts.loc[first, "doc_id"] = -(1 << 63)
    return cuts.drop_duplicates()


def _range_of(h: pd.Series, doc_id: pd.Series, cuts: pd.DataFrame) -> np.ndarray:
    """The number of splitters at or before each key."""
    hs, ids = cuts["h"].to_numpy(), cuts["doc_id"].to_numpy()
    x = h.to_numpy()
    left, right = np.searchsorted(hs, x, "left"), np.searchsorted(hs, x, "right")
    out = right.copy()
    divided = right > left
    own = doc_id.to_numpy()
    for at in np.unique(left[divided]):  # a hash that is divided by doc_id
        rows = np.flatnonzero(divided & (left == at))
        out[rows] = at + np.searchsorted(ids[at : right[rows[0]]], own[rows], "right")
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, under the law of near equal bytes.

    A row's key is its text's hash, then its doc_id, so equal texts stand together. Sampled splitters cut the keys into
    many fine ranges; exact byte counts of those, one number a range, place the shards' boundaries. A range over a
    boundary is overfull: its rows are summed up in key order and divided there, each going where its middle byte lies: between groups of equal texts, or within
    a group of over WHOLE_GROUP of a shard's bytes. Slots number a shard's rows in key order.

    Null texts count one byte and are equal to empty ones; null doc_ids come first; rows that repeat have slots of their
    own; other columns are dropped; an empty table gives no rows. Texts are read once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    keys = cut(keys.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    n = keys.count()
    cuts = _splitters(keys, max(shards * RANGES_PER_SHARD, min(MOST_RANGES, n // RANGE_ROWS)))

    @F.pandas_udf("int")
    def range_of(h: pd.Series, doc_id: pd.Series) -> pd.Series:
        return pd.Series(_range_of(h, doc_id, cuts))

    keys = cut(keys.withColumn("range", range_of("h", "id")))
    sums = keys.groupBy("range").agg(F.sum("size").alias("bytes")).toPandas().sort_values("range")  # a row for each range
    total = int(sums["bytes"].sum())
    before = dict(zip(sums["range"].tolist(), (sums["bytes"].cumsum() - sums["bytes"]).tolist(), strict=True))
    bounds = [total * (i + 1) / shards for i in range(shards - 1)]
    spark = keys.sparkSession
    if not before:
        return keys.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "range int, before long"))
    order, group = Window.partitionBy("range").orderBy("h", "id", "size"), Window.partitionBy("range", "h")
    rows = keys.join(starts, "range").withColumn("start", F.col("before") - F.col("size") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.sum("size").over(group)
    middle = F.when(whole <= WHOLE_GROUP * total / shards, F.min("start").over(group) + whole / 2).otherwise(F.col("start") + F.col("size") / 2)
    rows = rows.withColumn("middle", middle)
    placed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("middle"))) if bounds else F.lit(0)
    rows = rows.withColumn("shard", placed).withColumn("nth", F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "id", "size")))
    rows = cut(rows.select("doc_id", "size", "text_crc32", "range", "shard", "nth"))
    counts = rows.groupBy("shard", "range").count().toPandas().sort_values(["shard", "range"])  # a row for each range, and one more for each boundary
    counts["offset"] = counts.groupby("shard")["count"].cumsum() - counts["count"]
    offsets = F.broadcast(spark.createDataFrame(counts[["shard", "range", "offset"]].values.tolist(), "shard int, range int, offset long"))
    return rows.join(offsets, ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
