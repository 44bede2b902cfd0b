"""What a query writes on the way is deleted when it is not needed any more."""

from pathlib import Path

import __spark_entry__ as entry
from pyspark.sql import functions as F

from braidline.runtime import _MADE, cut, forget, scratch


def sizes(spark):
    return [sum(f.stat().st_size for f in Path(p.removeprefix("file://")).rglob("*.parquet")) for p in _MADE.get(spark.sparkContext.applicationId, [])]


def test_only_what_is_kept_stays(spark):
    forget(spark)
    with scratch(spark) as keep:
        own = cut(spark.range(10))
        kept = keep(own.where("id > 3"))
        cut(own)
    assert kept.count() == 6 and len([n for n in sizes(spark) if n]) == 1


def test_graphs_leave_few_tables(spark):
    forget(spark)
    got = entry.queries()["q38_extended_boundaries"](spark, "/root/testdata/sf0.001")
    left = len([n for n in sizes(spark) if n])
    assert got.agg(F.count("*")).first()[0] and left <= 8  # 19 before
    forget(spark)
