"""Queries on intervals that overlap so much, or are so near, that they are one.

A transcript of one exon is an event's interval, four minutes for each started unit of value; a chromosome is two users.
Coverage is the value in hundredths, so that its weighted sums are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlaps
from ..runtime import table
from .registry import DAY, HOUR, _as_intervals, query

_SINGLES = """single AS (SELECT user_id // 2 AS chrom, event_id AS id, epoch_us(ts) AS l, epoch_us(ts) + (floor(value)::BIGINT + 1) * 240000000 AS r, round(value * 100)::BIGINT AS cov FROM events)"""


def _singles(spark: SparkSession, d: str) -> DataFrame:
    events = _as_intervals(table(spark, d, "events"))
    return events.select(F.floor(F.col("chrom") / 2).alias("chrom"), "id", "l", (F.col("l") + (F.col("r") - F.col("l")) * 240).alias("r"), F.round(F.col("value") * 100).cast("long").alias("cov"))


@query(f"""WITH RECURSIVE {_SINGLES}, links AS (SELECT a.chrom, a.id AS a, b.id AS b FROM single a JOIN single b ON a.chrom = b.chrom AND a.l < b.r AND b.l < a.r WHERE 10 * (least(a.r, b.r) - greatest(a.l, b.l)) >= 9 * least(a.r - a.l, b.r - b.l)),
    seen(a, b) AS (SELECT a, b FROM links UNION SELECT seen.a, links.b FROM seen JOIN links ON links.a = seen.b),
    class AS (SELECT a AS id, min(b) AS class FROM seen GROUP BY a)
    SELECT chrom, min(l) AS l, max(r) AS r, count(*)::BIGINT AS n, sum(cov * (r - l)) / sum(r - l) AS cov FROM single JOIN class USING (id) GROUP BY chrom, class""")
def q57_overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of one exon as one where nine tenths of the shorter are shared, directly or by others."""
    classes = overlaps.overlap_classes(_singles(spark, d), ["chrom"], "id", width=DAY)
    return overlaps.as_one(classes, ["chrom"], "class", "cov")


@query(f"""WITH {_SINGLES}, top AS (SELECT * FROM single a WHERE NOT EXISTS (SELECT 1 FROM single b WHERE b.chrom = a.chrom AND b.l <= a.l AND b.r >= a.r AND (b.l < a.l OR b.r > a.r OR b.id < a.id))),
    runs AS (SELECT *, CASE WHEN l - lag(r) OVER w < {HOUR} THEN 0 ELSE 1 END AS new FROM top WINDOW w AS (PARTITION BY chrom ORDER BY l)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY l) AS run FROM runs)
    SELECT chrom, min(l) AS l, max(r) AS r, count(*)::BIGINT AS n, sum(cov * (r - l)) / sum(r - l) AS cov FROM numbered GROUP BY chrom, run""")
def q58_joined_singles(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of one exon that lie in no other, those less than an hour apart as one."""
    return overlaps.joined_singles(_singles(spark, d), ["chrom"], "id", "cov", gap=HOUR, width=DAY)
