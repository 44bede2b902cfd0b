"""Queries on regions of loci and the graphs of their parts; see registry for how the given tables stand in for reads.

A chromosome is two users, so loci have up to a hundred parts. A read is an event's interval, four minutes for each started
unit of value; a purchase's read goes on, after a junction, with the next event in the locus. A known site is the base half a
second after the start of each error; reads have A or T there by their value, clicks were not looked at. Which of the
two is which allele, or whether that is known at all, is a matter of the site's second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, paths, regions, revise, rules
from ..runtime import cut, scratch, table
from ..sources import gvf
from .registry import DAY, HOUR, _as_intervals, query

KEYS = ["chrom", "locus"]

_LOCI = f"""ev AS (SELECT user_id // 2 AS chrom, event_id AS id, epoch_us(ts) AS l, epoch_us(ts) + (floor(value)::BIGINT + 1) * 240000000 AS r, event_type AS ale, value FROM events),
    reach AS (SELECT *, max(r) OVER (PARTITION BY chrom ORDER BY l, r, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
    marked AS (SELECT *, max(CASE WHEN m IS NULL OR l > m + {12 * HOUR} THEN l END) OVER (PARTITION BY chrom ORDER BY l, r, id ROWS UNBOUNDED PRECEDING) AS locus FROM reach)"""
_GT = """CASE WHEN ale NOT IN ('A', 'T') OR l // 1000000 % 7 = 0 THEN 'UNPHASED' WHEN l // 1000000 % 5 = 0 THEN 'NONSPECIFIC' WHEN (l // 1000000 % 2 = 0) = (ale = 'A') THEN 'ALLELE1' ELSE 'ALLELE2' END"""


def _loci(spark: SparkSession, d: str) -> DataFrame:
    reads = _as_intervals(table(spark, d, "events")).select(F.floor(F.col("chrom") / 2).alias("chrom"), "id", "l", (F.col("l") + (F.col("r") - F.col("l")) * 240).alias("r"), "ale", "value")
    return intervals.sessionize(reads, ["chrom"], gap=12 * HOUR, tie=("id",), width=DAY)


def _genotype() -> Column:
    """Of allele ale at the site l."""
    second = F.floor(F.col("l") / 1_000_000)
    return F.when(second % 7 == 0, "UNPHASED").when(second % 5 == 0, "NONSPECIFIC").when((second % 2 == 0) == (F.col("ale") == "A"), "ALLELE1").otherwise("ALLELE2")


_PIECES = f"""{_LOCI}, reads AS (SELECT chrom, locus, id, l, r, ale AS kind, value, lead(l) OVER w AS nl, lead(r) OVER w AS nr FROM marked WINDOW w AS (PARTITION BY chrom, locus ORDER BY l, id)),
    split AS (SELECT * FROM reads WHERE kind = 'purchase' AND nl > r),
    blocks AS (SELECT chrom, locus, id, l, r, kind, value FROM reads UNION ALL SELECT chrom, locus, id, nl, nr, kind, value FROM split),
    sites AS (SELECT DISTINCT chrom, locus, l + 500000 AS p FROM reads WHERE kind = 'error'),
    hits AS (SELECT b.*, p, CASE WHEN kind = 'click' THEN 'N' WHEN value >= 100 THEN 'A' ELSE 'T' END AS ale FROM blocks b JOIN sites s ON b.chrom = s.chrom AND b.locus = s.locus AND p >= b.l AND p < b.r),
    lefts AS (SELECT *, row_number() OVER (PARTITION BY chrom, locus, id, l ORDER BY x) AS k FROM (SELECT chrom, locus, id, l, l AS x FROM blocks UNION ALL SELECT chrom, locus, id, l, p + 1 FROM hits)),
    rights AS (SELECT *, row_number() OVER (PARTITION BY chrom, locus, id, l ORDER BY y) AS k FROM (SELECT chrom, locus, id, l, r AS y FROM blocks UNION ALL SELECT chrom, locus, id, l, p FROM hits)),
    pieces AS (SELECT chrom, locus, id, x AS l, y AS r, '$' AS ale FROM lefts JOIN rights USING (chrom, locus, id, l, k) WHERE x < y UNION ALL SELECT chrom, locus, id, p, p + 1, ale FROM hits)"""
_REGIONS = f"""{_PIECES}, alleles AS (SELECT chrom, locus, l, r, ale, count(*)::BIGINT AS n FROM pieces WHERE ale <> '$' GROUP BY ALL),
    ends AS (SELECT chrom, locus, l AS p, 1 AS d FROM pieces WHERE ale = '$' UNION ALL SELECT chrom, locus, r, -1 FROM pieces WHERE ale = '$'),
    steps AS (SELECT chrom, locus, p, sum(d) AS d FROM ends GROUP BY ALL),
    depths AS (SELECT chrom, locus, p AS l, lead(p) OVER w AS r, (sum(d) OVER w)::BIGINT AS depth FROM steps WINDOW w AS (PARTITION BY chrom, locus ORDER BY p)),
    cov AS (SELECT * FROM depths WHERE depth > 0),
    marks AS (SELECT chrom, locus, locus AS p, 1 AS k FROM marked UNION ALL SELECT chrom, locus, max(r), 2 FROM marked GROUP BY chrom, locus UNION ALL SELECT chrom, locus, r, 4 FROM split UNION ALL SELECT chrom, locus, nl, 8 FROM split UNION ALL SELECT chrom, locus, l, 16 FROM alleles UNION ALL SELECT chrom, locus, r, 32 FROM alleles),
    bounds AS (SELECT chrom, locus, p, bit_or(k) AS ty FROM marks GROUP BY ALL),
    seg AS (SELECT chrom, locus, p AS l, lead(p) OVER w AS r, ty AS ltype, lead(ty) OVER w AS rtype FROM bounds WINDOW w AS (PARTITION BY chrom, locus ORDER BY p)),
    regs AS (SELECT seg.*, coalesce(ale, '$') AS ale, n FROM seg LEFT JOIN alleles USING (chrom, locus, l, r) WHERE seg.r IS NOT NULL),
    inside AS (SELECT g.chrom, g.locus, g.l AS rl, g.r AS rr, greatest(c.l, g.l) AS l, least(c.r, g.r) AS r, depth FROM regs g JOIN cov c ON g.chrom = c.chrom AND g.locus = c.locus AND c.l < g.r AND c.r > g.l WHERE g.ale = '$')"""
_STATS = "(sum(depth * (r - l)) / {length}) AS m, sum(depth * depth * (r - l)) AS s2, sum(depth * (r - l)) AS s1, sum(r - l) AS c, max(depth) AS high"
_DEV = "coalesce(sqrt(greatest((s2 - 2 * m * s1 + m * m * c) / {length}, 0)), 1)"
_PARTS = f"""{_REGIONS}, fresh AS (SELECT *, CASE WHEN l = lag(r) OVER (PARTITION BY chrom, locus, rl, rr ORDER BY l) THEN 0 ELSE 1 END AS new FROM inside),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY chrom, locus, rl, rr ORDER BY l) AS run FROM fresh),
    runs AS (SELECT chrom, locus, rl, rr, min(l) AS a, max(r) AS b, sum(depth * (r - l)) AS s1, sum(depth * depth * (r - l)) AS s2, max(depth)::BIGINT AS high FROM numbered GROUP BY chrom, locus, rl, rr, run),
    typed AS (SELECT runs.*, ltype, rtype, s1 / (b - a) AS m FROM runs JOIN regs g ON g.chrom = runs.chrom AND g.locus = runs.locus AND g.l = rl AND g.r = rr AND g.ale = '$'),
    edge AS (SELECT chrom, locus, rl, rr, ltype, rtype, min(a) AS first, max(b) AS last FROM typed GROUP BY ALL),
    parts AS (SELECT chrom, locus, rl, rr, '$' AS ale, a AS l, b AS r, CASE WHEN a = rl THEN ltype ELSE 1 END AS ltype, CASE WHEN b = rr THEN rtype ELSE 2 END AS rtype, m AS ave, sqrt(greatest((s2 - 2 * m * s1 + m * m * (b - a)) / (b - a), 0)) AS dev, high,
            (b - a < 15 OR m < 1.5 OR high < 3) AND NOT (a = rl AND ltype & 40 > 0) AND NOT (b = rr AND rtype & 20 > 0) AND NOT (a = rl AND b = rr) AS empty FROM typed
        UNION ALL SELECT chrom, locus, l, r, ale, l, r, ltype, rtype, n::DOUBLE, 0.01::DOUBLE, n, false FROM regs WHERE ale <> '$'
        UNION ALL SELECT chrom, locus, rl, rr, '$', rl, rl + 1, ltype, 2, 0.01, 1.0, 0, false FROM edge WHERE ltype & 8 > 0 AND first > rl
        UNION ALL SELECT chrom, locus, rl, rr, '$', rr - 1, rr, 1, rtype, 0.01, 1.0, 0, false FROM edge WHERE rtype & 4 > 0 AND last < rr)"""
_WAYS = f"""{_PARTS}, pid AS (SELECT *, {_GT} AS gt, row_number() OVER (PARTITION BY chrom, locus ORDER BY l, r, ale)::BIGINT AS pid FROM parts),
    met AS (SELECT DISTINCT p.chrom, p.locus, p.id, g.l AS rl, g.r AS rr, p.ale FROM pieces p JOIN regs g ON p.chrom = g.chrom AND p.locus = g.locus AND p.ale = g.ale AND g.l < p.r AND g.r > p.l),
    through AS (SELECT met.chrom, met.locus, met.id, rl, pid FROM met LEFT JOIN pid USING (chrom, locus, rl, rr, ale)),
    ways AS (SELECT chrom, locus, id, list(pid ORDER BY rl, pid) AS way FROM through GROUP BY ALL HAVING bool_and(pid IS NOT NULL))"""
_GRAPH = f"""{_WAYS}, threaded AS (SELECT chrom, locus, s, t, count(*)::DOUBLE AS w FROM (SELECT chrom, locus, unnest(list_zip(way[:-2], way[2:])) AS e, e[1] AS s, e[2] AS t FROM ways WHERE len(way) > 1) GROUP BY ALL),
    touching AS (SELECT a.chrom, a.locus, a.pid AS s, b.pid AS t FROM pid a JOIN pid b ON a.chrom = b.chrom AND a.locus = b.locus AND a.r = b.l WHERE NOT (a.gt = 'ALLELE1' AND b.gt = 'ALLELE2' OR a.gt = 'ALLELE2' AND b.gt = 'ALLELE1')),
    within AS (SELECT * FROM threaded UNION ALL SELECT *, 0.01 FROM (SELECT * FROM touching EXCEPT SELECT chrom, locus, s, t FROM threaded)),
    near AS (SELECT *, CASE WHEN lag(r) OVER w = l THEN lag(ave) OVER w ELSE 0 END AS left_ave, CASE WHEN lead(l) OVER w = r THEN lead(ave) OVER w ELSE 0 END AS right_ave, max(pid) OVER (PARTITION BY chrom, locus) + 1 AS sink FROM pid WINDOW w AS (PARTITION BY chrom, locus ORDER BY pid)),
    graph AS (SELECT * FROM within
        UNION ALL SELECT chrom, locus, 0, pid, greatest(ave - left_ave, 0.01) FROM near WHERE ltype & 1 > 0 OR (ale <> '$' AND NOT EXISTS (SELECT 1 FROM within i WHERE i.chrom = near.chrom AND i.locus = near.locus AND i.t = pid))
        UNION ALL SELECT chrom, locus, pid, sink, greatest(ave - right_ave, 0.01) FROM near WHERE rtype & 2 > 0 OR (ale <> '$' AND NOT EXISTS (SELECT 1 FROM within i WHERE i.chrom = near.chrom AND i.locus = near.locus AND i.s = pid)))"""


class Reads:
    """The reads of all loci, and what is made of them, each step written once."""

    def __init__(self, spark: SparkSession, d: str):
        with scratch(spark) as keep:
            self._make(spark, d, keep)

    def _make(self, spark: SparkSession, d: str, keep: Callable) -> None:
        self.spark = spark
        self.rows = keep(_loci(spark, d).withColumnRenamed("ale", "kind").withColumn("_bin", F.floor(F.col("l") / DAY)))
        nexts = intervals.following(self.rows, KEYS, "_bin", ["l", "id"], F.struct("l", "r"), "next").drop("_bin")
        split = nexts.where("kind = 'purchase' and next.l > r")
        self.loci = self.rows.groupBy(*KEYS).agg(F.max("r").alias("r")).withColumn("l", F.col("locus"))
        self.junctions = keep(split.select(*KEYS, F.col("r").alias("a"), F.col("next.l").alias("b")))
        blocks = nexts.select(*KEYS, "id", "l", "r", "kind", "value").union(split.select(*KEYS, "id", "next.l", "next.r", "kind", "value"))
        sites = self.rows.where("kind = 'error'").select(*KEYS, (F.col("l") + 500_000).alias("p")).distinct()
        seen = intervals.points_in_intervals(sites, blocks.where("kind <> 'click'"), KEYS, width=DAY)
        seen = seen.select(*KEYS, "id", "p", F.when(F.col("value") >= 100, "A").otherwise("T").alias("ale")).distinct()
        self.known = sites.select(*KEYS, F.col("p").alias("l"), F.explode(F.array(F.lit("A"), F.lit("T"))).alias("ale")).withColumn("gt", _genotype())
        self.pieces = keep(regions.split_by_sites(blocks.select(*KEYS, "id", "l", "r"), sites, seen, KEYS, "id", width=DAY))

    def regions(self) -> tuple[DataFrame, DataFrame]:
        """(regions, depths)."""
        with scratch(self.spark) as keep:
            depths = keep(regions.depth_of(self.pieces, KEYS, DAY))
        alleles = self.pieces.where(F.col("ale") != regions.PLAIN).groupBy(*KEYS, "l", "r", "ale").agg(F.count("*").alias("n"))
        return regions.regions(self.loci, self.junctions, alleles, depths, KEYS, DAY), depths

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """(regions, parts with their numbers)."""
        with scratch(self.spark) as keep:
            found, depths = self.regions()
            found = keep(found)
            return found, keep(regions.genotyped(regions.numbered(regions.partial_exons(found, depths, KEYS, DAY), KEYS, "pid"), self.known, KEYS))

    def ways(self) -> tuple[DataFrame, DataFrame]:
        """(parts, ways)."""
        found, parts = self.parts()
        return parts, regions.ways_of_reads(self.pieces, found, parts, KEYS, "id", DAY)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {_PIECES} SELECT chrom, locus, id, l, r, ale FROM pieces")
def q30_split_by_sites(spark: SparkSession, d: str) -> DataFrame:
    """Reads' blocks divided at known sites, with the allele that each read has there."""
    return Reads(spark, d).pieces


@query(f"""WITH {_REGIONS}, sums AS (SELECT chrom, locus, rl AS l, rr AS r, {_STATS.format(length="(rr - rl)")} FROM inside GROUP BY chrom, locus, rl, rr)
    SELECT chrom, locus, l, r, ale, ltype, rtype, n, round(CASE WHEN n IS NOT NULL THEN n ELSE coalesce(m, 0) END, 6) AS ave, round(CASE WHEN n IS NOT NULL THEN 0.01 ELSE {_DEV.format(length="(r - l)")} END, 6) AS dev, coalesce(n, high, 0)::BIGINT AS high FROM regs LEFT JOIN sums USING (chrom, locus, l, r)""")
def q31_regions(spark: SparkSession, d: str) -> DataFrame:
    """What lies between neighbouring ends, junctions and sites of each locus, one for each allele at a site, with its depth."""
    return _rounded(Reads(spark, d).regions()[0], "ave", "dev")


@query(f"WITH {_PARTS} SELECT chrom, locus, rl, rr, ale, l, r, ltype, rtype, round(ave, 6) AS ave, round(dev, 6) AS dev, high, empty FROM parts")
def q32_partial_exons(spark: SparkSession, d: str) -> DataFrame:
    """The covered parts of the regions."""
    return _rounded(Reads(spark, d).parts()[1].drop("pid", "gt"), "ave", "dev")


@query(f"WITH {_WAYS} SELECT chrom, locus, id, array_to_string(way, ',') AS way FROM ways")
def q33_ways_of_reads(spark: SparkSession, d: str) -> DataFrame:
    """The parts that each read goes through."""
    return Reads(spark, d).ways()[1].withColumn("way", F.array_join("way", ","))


@query(f"WITH {_GRAPH} SELECT chrom, locus, s, t, round(sum(w), 6) AS w FROM graph GROUP BY ALL")
def q34_splice_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each locus's graph of parts."""
    parts, ways = Reads(spark, d).ways()
    return _rounded(regions.splice_graph(parts, ways, KEYS)[1].groupBy(*KEYS, "s", "t").agg(F.sum("w").alias("w")), "w")


_VERTICES = f"""{_GRAPH}, e AS (SELECT chrom, locus, s, t, sum(w) AS w FROM graph GROUP BY ALL),
    vertex AS (SELECT *, greatest(ave, 0.01) AS weight FROM pid),
    ended AS (SELECT e.*, a.r AS s_r, b.l AS t_l FROM e LEFT JOIN vertex a ON a.chrom = e.chrom AND a.locus = e.locus AND a.pid = e.s LEFT JOIN vertex b ON b.chrom = e.chrom AND b.locus = e.locus AND b.pid = e.t),
    i AS (SELECT chrom, locus, t AS pid, count(*) AS n_in, sum(w) AS w_in, min(s) AS before, bool_or(s = 0) AS starts, coalesce(bool_or(s_r = t_l), false) AS fl FROM ended GROUP BY ALL),
    o AS (SELECT chrom, locus, s AS pid, count(*) AS n_out, sum(w) AS w_out, min(t) AS after, bool_or(t_l IS NULL) AS ends, coalesce(bool_or(s_r = t_l), false) AS fr FROM ended GROUP BY ALL),
    around AS (SELECT vertex.* , coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(w_in, 0) AS w_in, coalesce(w_out, 0) AS w_out, before, after, coalesce(starts, false) AS starts, coalesce(ends, false) AS ends, coalesce(fl, false) AS fl, coalesce(fr, false) AS fr
        FROM vertex LEFT JOIN i USING (chrom, locus, pid) LEFT JOIN o USING (chrom, locus, pid) WHERE NOT empty AND (n_in IS NOT NULL OR n_out IS NOT NULL))"""


def _edges_of(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.groupBy(*KEYS, "s", "t").agg(F.sum("w").alias("w"))


def _vertices_of(parts: DataFrame) -> DataFrame:
    return parts.select(*KEYS, F.col("pid").alias("v"), "l", "r", "ale", "gt", F.greatest("ave", F.lit(regions.LEAST_WEIGHT)).alias("weight"), "dev", "ltype", "rtype", "empty")


def _graph(spark: SparkSession, d: str) -> tuple[Reads, DataFrame, DataFrame]:
    """The reads, and the vertices and edges of the graphs of their loci."""
    reads = Reads(spark, d)
    parts, ways = reads.ways()
    with scratch(spark) as keep:
        edges = keep(_edges_of(regions.splice_graph(parts, ways, KEYS)[1]))
    return reads, _vertices_of(parts), edges


@query(f"""WITH {_VERTICES}, outs AS (SELECT chrom, locus, s AS before, count(*) AS before_n FROM e GROUP BY ALL), ins AS (SELECT chrom, locus, t AS after, count(*) AS after_n FROM e GROUP BY ALL)
    SELECT chrom, locus, pid AS v FROM around JOIN outs USING (chrom, locus, before) JOIN ins USING (chrom, locus, after)
    WHERE ale = '$' AND dev < 0.01 AND n_in = 1 AND n_out = 1 AND (starts OR ends) AND (starts OR before_n > 1) AND (ends OR after_n > 1)""")
def q35_inner_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Vertices at an end that only seem to be there."""
    _, vertices, edges = _graph(spark, d)
    return rules.inner_boundaries(vertices, edges, KEYS)


@query(f"WITH {_VERTICES} SELECT chrom, locus, pid AS v FROM around WHERE r - l < 14400000000 AND NOT fl AND NOT fr AND (starts OR ends)")
def q36_small_exons(spark: SparkSession, d: str) -> DataFrame:
    """Parts of less than four hours that nothing touches, at an end: the rule's limit in the unit of these reads."""
    _, vertices, edges = _graph(spark, d)
    return rules.small_exons(vertices, edges, KEYS, 4 * HOUR)


@query(f"WITH {_VERTICES} SELECT a.chrom, a.locus, a.pid AS v FROM around a JOIN e ON e.chrom = a.chrom AND e.locus = a.locus AND e.s = before AND e.t = after WHERE n_in = 1 AND n_out = 1 AND NOT starts AND NOT ends AND fl AND fr AND weight <= 2 AND weight <= e.w")
def q37_contaminated_introns(spark: SparkSession, d: str) -> DataFrame:
    """Thin parts that a junction leads past."""
    _, vertices, edges = _graph(spark, d)
    return rules.contaminated_introns(vertices, edges, KEYS)


@query(f"""WITH {_VERTICES} SELECT chrom, locus, pid AS v, 'start' AS side, round(weight - w_in, 6) AS w FROM around WHERE ale = '$' AND NOT starts AND weight >= w_in AND weight >= 0.5 * w_in * w_in
    UNION ALL SELECT chrom, locus, pid, 'end', round(weight - w_out, 6) FROM around WHERE ale = '$' AND NOT ends AND weight >= w_out AND weight >= 0.5 * w_out * w_out""")
def q38_extended_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """New edges to start and end where a part is heavier than what leads there; by a lower bar than the rule's own, as few events are at once."""
    _, vertices, edges = _graph(spark, d)
    return _rounded(rules.extended_boundaries(vertices, edges, KEYS, square=0.5, more=0), "w")


@query(f"""WITH {_VERTICES}, beside AS (SELECT DISTINCT e.chrom, e.locus, CASE WHEN vertex.pid = s THEN t ELSE s END AS pid FROM e JOIN vertex ON vertex.chrom = e.chrom AND vertex.locus = e.locus AND pid IN (s, t) AND ale <> '$'),
    highest AS (SELECT chrom, locus, max(r) AS hi FROM marked GROUP BY ALL),
    classes AS (SELECT v.chrom, v.locus, v.pid AS v, CASE WHEN ale <> '$' THEN 'allelic' WHEN b.pid IS NOT NULL THEN 'adjacent' ELSE 'ordinary' END AS class, ltype & 1 > 0 AND rtype & 2 > 0 AND (l <> v.locus OR r <> hi) AS regional FROM vertex v JOIN highest h ON h.chrom = v.chrom AND h.locus = v.locus LEFT JOIN beside b ON b.chrom = v.chrom AND b.locus = v.locus AND b.pid = v.pid)
    SELECT * FROM classes WHERE (chrom, locus) IN (SELECT (chrom, locus) FROM classes GROUP BY chrom, locus HAVING NOT bool_and(regional))""")
def q39_vertex_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of all vertices, of graphs that are not regional throughout."""
    reads, vertices, edges = _graph(spark, d)
    classes = rules.vertex_classes(vertices, edges, reads.loci, KEYS)
    return classes.join(rules.without_regional_graphs(classes, KEYS), KEYS, "left_semi")


@query(f"""WITH {_WAYS}, step AS (SELECT chrom, locus, id, unnest(way) AS pid, generate_subscripts(way, 1) AS k FROM ways), placed AS (SELECT step.*, l, r, gt FROM step JOIN pid USING (chrom, locus, pid)),
    gts AS (SELECT chrom, locus, id, coalesce(arg_min(gt, k) FILTER (gt IN ('ALLELE1', 'ALLELE2')), CASE WHEN bool_or(gt = 'NONSPECIFIC') THEN 'NONSPECIFIC' END, 'UNPHASED') AS gt FROM placed GROUP BY ALL),
    upto AS (SELECT *, max(r) OVER (PARTITION BY chrom, locus, id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM placed),
    merged AS (SELECT *, sum(CASE WHEN m IS NULL OR l > m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, locus, id ORDER BY l, r) AS n FROM upto)
    SELECT chrom, locus, id, gts.gt AS gt, n::BIGINT AS exon, min(l) AS l, max(r) AS r FROM merged JOIN gts USING (chrom, locus, id) GROUP BY ALL""")
def q40_transcripts_of_ways(spark: SparkSession, d: str) -> DataFrame:
    """Reads' ways as transcripts: exons of parts that touch, and the first allele's genotype."""
    parts, ways = Reads(spark, d).ways()
    made = rules.transcripts(ways, parts, KEYS, "id")
    return made.select(*KEYS, "id", "gt", F.posexplode("exons").alias("k", "x")).select(*KEYS, "id", "gt", (F.col("k") + 1).cast("long").alias("exon"), "x.l", "x.r")


@query(f"""WITH {_REGIONS}, named AS (SELECT *, {_GT} AS gt FROM alleles), two AS (SELECT *, count(*) OVER (PARTITION BY chrom, locus, l, r) AS k FROM named WHERE gt IN ('ALLELE1', 'ALLELE2'))
    SELECT chrom, locus, l, r, ale, gt, n, 'lone' AS kind FROM two WHERE k = 1 AND n <= 3 UNION ALL SELECT chrom, locus, l, r, CASE ale WHEN 'A' THEN 'T' ELSE 'A' END, CASE gt WHEN 'ALLELE1' THEN 'ALLELE2' ELSE 'ALLELE1' END, NULL, 'counter' FROM two WHERE k = 1""")
def q41_lone_and_counter_alleles(spark: SparkSession, d: str) -> DataFrame:
    """Alleles of little depth that are alone at their site, and those that are missing there."""
    reads = Reads(spark, d)
    sites = reads.pieces.where(F.col("ale") != regions.PLAIN).groupBy(*KEYS, "l", "r", "ale").agg(F.count("*").alias("n"))
    sites = regions.genotyped(sites, reads.known, KEYS)
    lone = rules.lone_alleles(sites, KEYS).select(*KEYS, "l", "r", "ale", "gt", "n", F.lit("lone").alias("kind"))
    return lone.union(rules.counter_alleles(sites, reads.known, KEYS).select(*KEYS, "l", "r", "ale", "gt", F.lit(None).cast("long"), F.lit("counter")))


@query(f"""WITH {_LOCI}, votes AS (SELECT chrom, locus, count(*) FILTER (ale = 'view') AS p, count(*) FILTER (ale = 'click') AS q FROM marked GROUP BY ALL)
    SELECT chrom, locus, CASE WHEN p > q THEN '+' WHEN p < q THEN '-' ELSE '.' END AS strand FROM votes""")
def q42_strand_votes(spark: SparkSession, d: str) -> DataFrame:
    """The sign of each locus by the votes of its views (+) and clicks (-)."""
    xs = F.when(F.col("ale") == "view", "+").when(F.col("ale") == "click", "-").otherwise(".")
    return rules.strand_votes(_loci(spark, d).withColumn("xs", xs), KEYS, "xs")


_SURVIVING = f"""{_VERTICES}, ends_of AS (SELECT e.*, a.gt AS s_gt, b.gt AS t_gt, a.ale AS s_ale, b.ale AS t_ale FROM e LEFT JOIN vertex a ON a.chrom = e.chrom AND a.locus = e.locus AND a.pid = e.s LEFT JOIN vertex b ON b.chrom = e.chrom AND b.locus = e.locus AND b.pid = e.t)"""


def _closure_sql(name: str, edges: str, chosen: str) -> str:
    """CTEs; {name}(chrom, locus, s, t) is what with_heaviest_ways() gives for the chosen edges."""
    out = []
    for own, other in (("s", "t"), ("t", "s")):
        out.append(f"""{name}_{own}_open AS (SELECT chrom, locus, {other} AS v, arg_max({own}, w * 1000000000 - {own}) AS u FROM {edges} x WHERE NOT EXISTS (SELECT 1 FROM {chosen} c WHERE c.chrom = x.chrom AND c.locus = x.locus AND c.{other} = x.{other}) GROUP BY chrom, locus, {other}),
        {name}_{own}(chrom, locus, v) AS (SELECT DISTINCT o.chrom, o.locus, v FROM {name}_{own}_open o JOIN {chosen} c ON c.chrom = o.chrom AND c.locus = o.locus AND c.{own} = v
            UNION SELECT n.chrom, n.locus, n.v FROM {name}_{own} m JOIN {name}_{own}_open o ON o.chrom = m.chrom AND o.locus = m.locus AND o.v = m.v JOIN {name}_{own}_open n ON n.chrom = o.chrom AND n.locus = o.locus AND n.v = o.u)""")
    part = lambda own, s, t: f"SELECT o.chrom, o.locus, {s} AS s, {t} AS t FROM {name}_{own}_open o JOIN {name}_{own} m ON m.chrom = o.chrom AND m.locus = o.locus AND m.v = o.v"
    return f"{', '.join(out)}, {name} AS (SELECT chrom, locus, s, t FROM {chosen} UNION {part('s', 'o.u', 'o.v')} UNION {part('t', 'o.v', 'o.u')})"


_COPIES = ", ".join(f"""copy{k} AS (SELECT * FROM ends_of WHERE coalesce(s_gt, '') <> '{other}' AND coalesce(t_gt, '') <> '{other}'), own{k} AS (SELECT chrom, locus, s, t FROM copy{k} WHERE coalesce(s_gt, '') = '{mine}' OR coalesce(t_gt, '') = '{mine}'), {_closure_sql(f"way{k}", f"copy{k}", f"own{k}")}""" for k, (mine, other) in enumerate((("ALLELE1", "ALLELE2"), ("ALLELE2", "ALLELE1"))))


@query(f"""WITH RECURSIVE {_SURVIVING}, {_COPIES}, inner_edges AS (SELECT * FROM ends_of WHERE s_ale IS NOT NULL AND t_ale IS NOT NULL),
    sides AS (SELECT chrom, locus, s AS a, t AS b FROM inner_edges UNION ALL SELECT chrom, locus, t, s FROM inner_edges),
    seen(chrom, locus, a, b) AS (SELECT chrom, locus, a, a FROM sides UNION SELECT c.chrom, c.locus, c.a, x.b FROM seen c JOIN sides x ON x.chrom = c.chrom AND x.locus = c.locus AND x.a = c.b),
    comp AS (SELECT chrom, locus, a AS s, min(b) AS c FROM seen GROUP BY ALL),
    ranked AS (SELECT i.*, row_number() OVER (PARTITION BY i.chrom, i.locus, c ORDER BY w DESC, i.s DESC, i.t DESC) AS n FROM inner_edges i JOIN comp ON comp.chrom = i.chrom AND comp.locus = i.locus AND comp.s = i.s WHERE s_ale = '$' AND t_ale = '$' AND w >= 1.5),
    chosen AS (SELECT chrom, locus, s, t FROM ends_of WHERE w >= 1.6 UNION SELECT chrom, locus, s, t FROM ranked WHERE n = 1 UNION SELECT * FROM way0 UNION SELECT * FROM way1),
    {_closure_sql("kept", "ends_of", "chosen")} SELECT e.chrom, e.locus, e.s, e.t, round(e.w, 6) AS w FROM e SEMI JOIN kept USING (chrom, locus, s, t)""")
def q47_surviving_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that stay when weak ones go."""
    _, vertices, edges = _graph(spark, d)
    return _rounded(rules.surviving_edges(vertices, edges, KEYS), "w")


_JOINED = f"""{_VERTICES}, j AS (SELECT e.*, a.r AS s_r, a.ale AS s_ale, a.weight AS s_weight, b.l AS t_l, b.ale AS t_ale, b.weight AS t_weight FROM e JOIN vertex a ON a.chrom = e.chrom AND a.locus = e.locus AND a.pid = e.s JOIN vertex b ON b.chrom = e.chrom AND b.locus = e.locus AND b.pid = e.t)"""


@query(f"""WITH {_JOINED}, b AS (SELECT *, s_r = t_l AND s_ale = '$' AS before, s_r = t_l AND t_ale = '$' AS behind FROM j),
    m AS (SELECT *, max(s_weight) FILTER (before) OVER (PARTITION BY chrom, locus, t) AS left_most, max(t_weight) FILTER (behind) OVER (PARTITION BY chrom, locus, s) AS right_most FROM b)
    SELECT chrom, locus, s, t, round(w, 6) AS w FROM m WHERE NOT before AND least(left_most, t_weight) >= 0.5 * w * w AND left_most IS NOT NULL OR NOT behind AND least(right_most, s_weight) >= 0.5 * w * w AND right_most IS NOT NULL""")
def q48_dwarfed_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Junctions beside much heavier parts that touch; by a lower bar than the rule's own, as few events are at once."""
    _, vertices, edges = _graph(spark, d)
    return _rounded(rules.small_junctions(vertices, edges, KEYS, square=0.5, more=0), "w")


@query(f"""WITH {_JOINED}, outs AS (SELECT chrom, locus, s, count(*) AS s_n FROM e GROUP BY ALL), ins AS (SELECT chrom, locus, t, count(*) AS t_n FROM e GROUP BY ALL)
    SELECT chrom, locus, s, t, round(CASE WHEN s_n = 1 THEN s_weight END, 6) AS to_end, round(CASE WHEN t_n = 1 THEN t_weight END, 6) AS from_start FROM j JOIN outs USING (chrom, locus, s) JOIN ins USING (chrom, locus, t)
    WHERE s_r < t_l AND (s_n = 1 AND s_weight >= 0.5 * w * w OR t_n = 1 AND t_weight >= 0.5 * w * w)""")
def q49_weak_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Junctions that are a heavy part's only edge, with what replaces them; by a lower bar than the rule's own, as few events are at once."""
    _, vertices, edges = _graph(spark, d)
    return _rounded(rules.weak_junctions(vertices, edges, KEYS, square=0.5, more=0), "to_end", "from_start")


@query()
def q50_revised_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graphs after all rules, with the limits of q36 and q48 and else the rules' own. No SQL: what applies next depends on each step."""
    _, vertices, edges = _graph(spark, d)
    own, links = revise.revised(vertices, edges, KEYS, least_length=4 * HOUR, dwarfed=(0.5, 0))
    empty = own.where("empty").select(*KEYS, F.col("v").alias("s"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("w"))
    return _rounded(links.withColumn("kind", F.lit("edge")).union(empty.withColumn("kind", F.lit("empty"))), "w")


_LINE = """chrom || chr(9) || 'braidline' || chr(9) || f || chr(9) || (l + 1) || chr(9) || r || chr(9) || '1000' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id "' || chrom || '.' || locus || '"; transcript_id "' || chrom || '.' || locus || '.' || id || '"; '"""


@query(f"""WITH {_WAYS}, step AS (SELECT chrom, locus, id, unnest(way) AS pid, generate_subscripts(way, 1) AS k FROM ways), placed AS (SELECT step.*, l, r, ale, gt FROM step JOIN pid USING (chrom, locus, pid)),
    gts AS (SELECT chrom, locus, id, coalesce(arg_min(gt, k) FILTER (gt IN ('ALLELE1', 'ALLELE2')), CASE WHEN bool_or(gt = 'NONSPECIFIC') THEN 'NONSPECIFIC' END, 'UNPHASED') AS gt FROM placed GROUP BY ALL),
    upto AS (SELECT *, max(r) OVER (PARTITION BY chrom, locus, id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM placed),
    merged AS (SELECT *, sum(CASE WHEN m IS NULL OR l > m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, locus, id ORDER BY l, r) AS n FROM upto),
    ex AS (SELECT chrom, locus, id, n::BIGINT AS exon, min(l) AS l, max(r) AS r FROM merged GROUP BY ALL), exl AS (SELECT chrom, locus, id, string_agg(l || '-' || r, ',' ORDER BY l) AS x FROM ex GROUP BY ALL),
    al AS (SELECT DISTINCT chrom, locus, id, l, r, ale FROM placed WHERE gt IN ('ALLELE1', 'ALLELE2')), alx AS (SELECT chrom, locus, id, string_agg(l || ale, ',' ORDER BY l, r, ale) AS y FROM al GROUP BY ALL),
    own AS (SELECT chrom, locus, gt, x, coalesce(y, '') AS y, min(id) AS id, count(*) AS reads FROM exl JOIN gts USING (chrom, locus, id) LEFT JOIN alx USING (chrom, locus, id) GROUP BY ALL),
    chain AS (SELECT *, CASE WHEN contains(x, ',') THEN regexp_replace(x, '^\\d+-|-\\d+$', '', 'g') END AS introns FROM own),
    sides AS (SELECT *, bool_or(gt <> 'ALLELE2') OVER w AS one, bool_or(gt <> 'ALLELE1') OVER w AS two FROM chain WINDOW w AS (PARTITION BY chrom, locus, introns)),
    filed AS (SELECT chrom, locus, id, gt, reads, CASE WHEN introns IS NULL THEN NULL WHEN one AND two THEN 'nonspec.multi-exon' WHEN one THEN 'allele1spec.multi-exon' ELSE 'allele2spec.multi-exon' END AS file FROM sides),
    rows AS (SELECT chrom, locus, id, 'transcript' AS f, min(l) AS l, max(r) AS r, NULL::BIGINT AS exon, NULL AS ale FROM ex GROUP BY chrom, locus, id UNION ALL SELECT chrom, locus, id, 'exon', l, r, exon, NULL FROM ex
        UNION ALL SELECT al.chrom, al.locus, al.id, 'variant', al.l, al.r, (SELECT count(*) FROM ex WHERE ex.chrom = al.chrom AND ex.locus = al.locus AND ex.id = al.id AND ex.l <= al.l), ale FROM al)
    SELECT file, {_LINE} || CASE f WHEN 'transcript' THEN 'allele "' || gt || '"; cov "' || reads || '.0000"; ' WHEN 'exon' THEN 'exon "' || exon || '"; ' ELSE 'exon "' || exon || '"; seq "' || ale || '"; allele "' || gt || '"; ' END AS line FROM rows JOIN filed USING (chrom, locus, id)""")
def q51_gvf_lines(spark: SparkSession, d: str) -> DataFrame:
    """The transcripts of reads' ways, equal ones of a genotype as one, as lines with their alleles, and the file that each is in."""
    parts, ways = Reads(spark, d).ways()
    own = rules.transcripts(ways, parts, KEYS, "id").join(rules.alleles_of_ways(ways, parts, KEYS, "id"), [*KEYS, "id"], "left")
    own = own.groupBy(*KEYS, "gt", "exons", "alleles").agg(F.min("id").alias("id"), F.count("*").alias("reads"))
    gene = F.concat_ws(".", "chrom", "locus")
    filed = gvf.by_specificity(own, KEYS)
    return gvf.gvf_lines(filed, gene, F.concat_ws(".", gene, "id"), F.col("chrom").cast("string"), F.lit("+"), F.col("gt"), F.col("exons"), F.col("alleles"), F.col("reads")).select("file", "line")


@query(f"""WITH {_WAYS}, mates AS (SELECT chrom, locus, w.id, way AS a, lead(way) OVER (PARTITION BY chrom, locus ORDER BY m.l, id) AS b FROM ways w JOIN marked m USING (chrom, locus, id)),
    shared AS (SELECT *, list_position(b, a[-1]) AS p FROM mates), ok AS (SELECT chrom, locus, id, a || b[p + 1:] AS way FROM shared WHERE p > 0 AND a[len(a) - least(p, len(a)) + 1:] = b[p - least(p, len(a)) + 1:p]),
    long AS (SELECT chrom, locus, id, sum(r - l)::BIGINT AS length FROM (SELECT chrom, locus, id, unnest(way) AS pid FROM ok) JOIN pid USING (chrom, locus, pid) GROUP BY ALL)
    SELECT chrom, locus, id, array_to_string(way, ',') AS way, length, CASE WHEN length BETWEEN {HOUR} AND {12 * HOUR} THEN 1 ELSE 2 END AS type FROM ok JOIN long USING (chrom, locus, id)""")
def q52_joined_mates(spark: SparkSession, d: str) -> DataFrame:
    """The ways of a read and the next one of its locus as one where they overlap; of type 1 if the parts' length is in bounds (an hour to twelve)."""
    reads = Reads(spark, d)
    parts, ways = reads.ways()
    placed = ways.join(reads.rows.select(*KEYS, "id", "l", "_bin"), [*KEYS, "id"])
    mates = intervals.following(placed, KEYS, "_bin", ["l", "id"], F.col("way"), "mate").where("mate is not null")
    joined = cut(paths.joined_mates(mates, "way", "mate", "joined").where("joined is not null").select(*KEYS, "id", F.col("joined").alias("way")))
    length = joined.select(*KEYS, "id", F.explode("way").alias("pid")).join(parts.select(*KEYS, "pid", (F.col("r") - F.col("l")).alias("n")), [*KEYS, "pid"]).groupBy(*KEYS, "id").agg(F.sum("n").alias("length"))
    type_ = F.when(F.col("length").between(HOUR, 12 * HOUR), 1).otherwise(2)
    return joined.join(length, [*KEYS, "id"]).select(*KEYS, "id", F.array_join("way", ",").alias("way"), "length", type_.alias("type"))
