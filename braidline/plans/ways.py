"""Queries on alignments that are written as BAM and read back, and on the best ways through graphs.

A read is an event: it lies on one of twenty references, by its user, at its second; its alignment is made of its type,
value and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import cut, shared_dir, table
from ..sources import bam, sam
from .registry import _EDGES, _edges, query

REFERENCES = {f"ref{k}": 100_000_000 for k in range(20)}

_READS = """reads AS (SELECT 'e' || event_id AS qname, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 16 WHEN 'purchase' THEN 99 ELSE 256 END AS flag, 'ref' || user_id % 20 AS rname, (epoch_us(ts) // 1000000 - 1704067200)::INTEGER AS pos, (event_id % 61)::INTEGER AS mapq,
        event_id % 50 + 1 AS a, floor(value)::BIGINT % 40 + 1 AS b, event_id % 300 + 60 AS n, event_type AS kind, event_id AS id FROM events),
    aligned AS (SELECT *, CASE kind WHEN 'purchase' THEN a || 'M' || n || 'N' || b || 'M' WHEN 'click' THEN a || 'M2I' || b || 'M' WHEN 'view' THEN '3S' || a || 'M' || b || 'D' || b || 'M' ELSE a || 'M' END AS cigar, (id % 3 + 1)::INTEGER AS nh,
        (pos + CASE kind WHEN 'purchase' THEN a + n + b WHEN 'click' THEN a + b WHEN 'view' THEN a + 2 * b ELSE a END)::INTEGER AS rpos FROM reads)"""


def _alignments(events: DataFrame) -> DataFrame:
    kind, id_ = F.col("event_type"), F.col("event_id")
    a, b, n = id_ % 50 + 1, F.floor("value").cast("long") % 40 + 1, id_ % 300 + 60
    by = lambda view, click, purchase, other: F.when(kind == "view", view).when(kind == "click", click).when(kind == "purchase", purchase).otherwise(other)
    second = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    cigar = by(F.concat(F.lit("3S"), a, F.lit("M"), b, F.lit("D"), b, F.lit("M")), F.concat(a, F.lit("M2I"), b, F.lit("M")), F.concat(a, F.lit("M"), n, F.lit("N"), b, F.lit("M")), F.concat(a, F.lit("M")))
    return events.select(F.concat(F.lit("e"), id_).alias("qname"), by(F.lit(0), F.lit(16), F.lit(99), F.lit(256)).alias("flag"), F.concat(F.lit("ref"), F.col("user_id") % 20).alias("rname"), second.cast("int").alias("pos"), (id_ % 61).cast("int").alias("mapq"), cigar.alias("cigar"), F.lit("ACGTN").alias("seq"), (id_ % 3 + 1).cast("int").alias("nh"), F.when(kind == "purchase", "-").alias("xs"))


def _as_bam(spark: SparkSession, d: str) -> str:
    """The folder to which the alignments of all events are written as BAM."""
    path = shared_dir(spark)
    bam.write_bam(_alignments(table(spark, d, "events")), path, REFERENCES)
    return path


@query(f"WITH {_READS} SELECT qname, flag, rname, pos, rpos, mapq, cigar, 'ACGTN' AS seq, nh, CASE kind WHEN 'purchase' THEN '-' ELSE '.' END AS xs FROM aligned")
def q43_bam_scan(spark: SparkSession, d: str) -> DataFrame:
    """All alignments, from BAM files read in ranges of a quarter of a megabyte."""
    return bam.read_bam(spark, _as_bam(spark, d), split_bytes=1 << 18).select("qname", "flag", "rname", "pos", "rpos", "mapq", "cigar", "seq", "nh", "xs")


@query(f"""WITH {_READS}, good AS (SELECT * FROM aligned WHERE flag & 256 = 0 AND mapq >= 1 AND nh = 1),
    pieces AS (SELECT rname, pos AS l, pos + a AS r, 'block' AS kind FROM good WHERE kind IN ('purchase', 'click') UNION ALL SELECT rname, pos + a, pos + a + b, 'block' FROM good WHERE kind = 'click'
        UNION ALL SELECT rname, pos + a + n, rpos, 'block' FROM good WHERE kind = 'purchase' UNION ALL SELECT rname, pos, pos + a, 'block' FROM good WHERE kind = 'view' UNION ALL SELECT rname, pos + a + b, rpos, 'block' FROM good WHERE kind = 'view'
        UNION ALL SELECT rname, pos + a, pos + a + n, 'splice' FROM good WHERE kind = 'purchase')
    SELECT rname, l::INTEGER AS l, r::INTEGER AS r, kind, count(*)::BIGINT AS n FROM pieces GROUP BY ALL""")
def q44_bam_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Aligned and skipped stretches of the primary, uniquely mapped reads of BAM files, with how many reads have each."""
    reads = cut(sam.usable(bam.read_bam(spark, _as_bam(spark, d)), unique=True).select("rname", "pos", "cigar"))
    parts = [f(reads).select("rname", "l", "r", F.lit(kind).alias("kind")) for f, kind in ((sam.blocks, "block"), (sam.splices, "splice"))]
    return parts[0].union(parts[1]).groupBy("rname", "l", "r", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT t AS v FROM edges)),
    done(k, g, v, nth, least, length, way) AS (SELECT DISTINCT 0::BIGINT, g, 0::BIGINT, 1::BIGINT, [999999, 999999, 999999, 999999, 999999]::BIGINT[], 1::BIGINT, [0]::BIGINT[] FROM edges
        UNION ALL (SELECT * FROM (SELECT k + 1, g, v, nth, least, length, way FROM done WHERE k < (SELECT max(k) FROM nodes)
            UNION ALL SELECT * FROM (SELECT d.k + 1, d.g, e.t, row_number() OVER (PARTITION BY d.g ORDER BY list_sort(list_append(d.least, e.w))[1:5] DESC, d.length + 1, list_append(d.way, e.t)) AS nth, list_sort(list_append(d.least, e.w))[1:5], d.length + 1, list_append(d.way, e.t)
                FROM done d JOIN nodes n ON n.k = d.k + 1 JOIN edges e ON e.g = d.g AND e.s = d.v AND e.t = n.v) WHERE nth <= 10)))
    SELECT g, v, nth::INTEGER AS nth, array_to_string(least, ',') AS least, length, array_to_string(way, ',') AS way FROM done WHERE k = (SELECT max(k) FROM nodes)""")
def q45_best_ways(spark: SparkSession, d: str) -> DataFrame:
    """The ten best ways from the source to each vertex, by their five least weights."""
    edges = cut(_edges(spark, d))
    found = graph.best_ways(edges, edges.select("g").distinct().withColumn("source", F.lit(0).cast("long")), ["g"])
    return found.select("g", "v", "nth", F.array_join("least", ",").alias("least"), "length", F.array_join("way", ",").alias("way"))


@query(f"""WITH RECURSIVE {_EDGES}, deep(g, v, level) AS (SELECT DISTINCT g, 0::BIGINT, 0::BIGINT FROM edges UNION (SELECT e.g, e.t, max(d.level) + 1 FROM deep d JOIN edges e ON e.g = d.g AND e.s = d.v GROUP BY e.g, e.t))
    SELECT g, v, max(level) AS level FROM deep GROUP BY g, v""")
def q46_topological_levels(spark: SparkSession, d: str) -> DataFrame:
    """The number of edges of the longest way to each vertex."""
    return graph.topological_levels(_edges(spark, d), ["g"])
