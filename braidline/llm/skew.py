"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of at least this share of all rows are hot; there are at most as many as its inverse.
HOT_SHARE = 1e-4


def with_groups(rows: DataFrame, groups: DataFrame, key: str, salt: list[str], total: int) -> DataFrame:
    """rows left-joined with groups (key, n, ...; n: how many of the rows have the key; one row for each key).

    Hot groups are broadcast, at most 1 / HOT_SHARE of them; the rows that they answer are dealt by the salt columns, so
    that no task has all of one key. The other groups are joined by key. n is not added, and null keys match nothing.
    """
    others = [c for c in groups.columns if c not in (key, "n")]
    hot = F.col("n") >= F.lit(max(2.0, total * HOT_SHARE))
    rows = rows.join(F.broadcast(groups.where(hot).select(key, F.struct(*others).alias("_hot"))), key, "left")
    # one key of two parts: the group's and nothing, or nothing and the salt; as columns of their own, the optimizer would take the second for a constant
    part = lambda key, salt: F.struct(key.alias("key"), salt.cast("long").alias("salt"))
    rest = groups.where(~hot).select(part(F.col(key), F.lit(0)).alias("_key"), F.struct(*others).alias("_rest"))
    open_ = F.col("_hot").isNull() & F.col(key).isNotNull()
    rows = rows.withColumn("_key", part(F.when(open_, F.col(key)), F.when(open_, F.lit(0)).otherwise(F.xxhash64(*salt)))).join(rest, "_key", "left")
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("_key", "_hot", "_rest")), *(F.coalesce(f"_hot.{c}", f"_rest.{c}").alias(c) for c in others))
