"""Queries on the routes of reads through the vertices of loci's graphs, and on these graphs divided between two alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phases, regions, routes
from ..runtime import cut, scratch
from .loci import _VERTICES, KEYS, Reads, _edges_of, _rounded, _vertices_of
from .registry import query


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, ways) of the graphs of all loci."""
    parts, ways = Reads(spark, d).ways()
    with scratch(spark) as keep:
        ways = keep(ways)
        return _vertices_of(parts), keep(_edges_of(regions.splice_graph(parts, ways, KEYS)[1])), ways


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, edges, ways = _routed(spark, d)
    found = cut(routes.routes_of_ways(ways, KEYS))
    return cut(routes.legs(edges, found, KEYS)), found


@query(f"""WITH RECURSIVE {_VERTICES}, tri AS (SELECT DISTINCT chrom, locus, x[2] AS v, x[1] AS s, x[3] AS t FROM (SELECT chrom, locus, unnest(list_zip(way[:-3], way[2:-2], way[3:])) AS x FROM ways WHERE len(way) > 2)),
    ends2 AS (SELECT chrom, locus, t AS v, 's' || s AS a FROM e UNION ALL SELECT chrom, locus, s, 't' || t FROM e),
    sizes AS (SELECT chrom, locus, v, count(*) FILTER (a[1] = 's') AS n_in, count(*) FILTER (a[1] = 't') AS n_out FROM ends2 GROUP BY ALL HAVING n_in > 0 AND n_out > 0),
    links AS (SELECT chrom, locus, v, 's' || s AS a, 't' || t AS b FROM tri UNION ALL SELECT chrom, locus, v, 't' || t, 's' || s FROM tri),
    seen(chrom, locus, v, a, b) AS (SELECT chrom, locus, v, a, a FROM ends2 UNION SELECT n.chrom, n.locus, n.v, n.a, k.b FROM seen n JOIN links k ON k.chrom = n.chrom AND k.locus = n.locus AND k.v = n.v AND k.a = n.b),
    part AS (SELECT chrom, locus, v, a, min(b) AS p FROM seen GROUP BY ALL),
    counts AS (SELECT chrom, locus, v, count(DISTINCT p) AS parts, count(DISTINCT p) FILTER (a[1] = 's') AS i, count(DISTINCT p) FILTER (a[1] = 't') AS o FROM part GROUP BY ALL),
    many AS (SELECT chrom, locus, v, count(*) AS n FROM tri GROUP BY ALL)
    SELECT chrom, locus, v, CASE WHEN n_in = 1 OR n_out = 1 THEN 'trivial' WHEN n IS NULL THEN 'simple' WHEN parts = 1 THEN 'single' WHEN i = 1 OR o = 1 THEN 'multiple' ELSE 'hyper' END AS class,
        CASE WHEN n_in = 1 OR n_out = 1 THEN n_in + n_out WHEN n IS NULL THEN n_in + n_out - 1 WHEN parts = 1 OR i = 1 OR o = 1 THEN n - n_in - n_out + 2 * parts ELSE parts - 1 END::BIGINT AS degree, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out, parts::BIGINT AS parts
    FROM sizes JOIN counts USING (chrom, locus, v) LEFT JOIN many USING (chrom, locus, v)""")
def q53_route_classes(spark: SparkSession, d: str) -> DataFrame:
    """What the reads' routes through each vertex say of how it can be taken apart."""
    return routes.route_classes(*_legs(spark, d), KEYS)


@query()
def q54_vertex_splits(spark: SparkSession, d: str) -> DataFrame:
    """How vertices of which routes leave a choice divide best in two. No SQL: the closest sums of subsets."""
    legs, found = _legs(spark, d)
    open_ = routes.route_classes(legs, found, KEYS).where("class in ('simple', 'hyper')").select(*KEYS, "v")
    best = routes.splits(legs.join(open_, [*KEYS, "v"], "left_semi"), KEYS)
    return best.select(*KEYS, "v", "imbalance", F.array_join("ins", ",").alias("ins"), F.array_join("outs", ",").alias("outs"))


@query()
def q55_allele_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of both alleles, by how the alleles' parts divide what is around them. No SQL: each step depends on those before."""
    vertices, edges, _ = _routed(spark, d)
    shares = cut(phases.allele_shares(vertices, edges, KEYS)[1])
    return _rounded(phases.allele_graphs(vertices, shares, KEYS), "w")


@query()
def q56_allele_ways(spark: SparkSession, d: str) -> DataFrame:
    """The ways of reads in each allele's graph. No SQL, as for the graphs."""
    vertices, edges, ways = _routed(spark, d)
    shares = cut(phases.allele_shares(vertices, edges, KEYS)[1])
    counted = ways.groupBy(*KEYS, "way").agg(F.count("*").alias("n"))
    return phases.allele_ways(counted, shares, KEYS).withColumn("way", F.array_join("way", ","))
