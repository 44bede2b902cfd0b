"""The registered queries, and the DuckDB SQL that each must equal.

The operators work on intervals, paths and graphs. Here they run over the given tables: an event is an interval of its
user (from its time, one second for each started unit of value, in microseconds), an order is a path through its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, intervals, paths
from ..runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR

_EV = """ev AS (SELECT user_id AS chrom, event_id AS id, epoch_us(ts) AS l, epoch_us(ts) + (floor(value)::BIGINT + 1) * 1000000 AS r, event_type AS ale, value FROM events)"""
_LOCI = f"""{_EV},
    reach AS (SELECT *, max(r) OVER (PARTITION BY chrom ORDER BY l, r, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
    marked AS (SELECT *, max(CASE WHEN m IS NULL OR l > m + {12 * HOUR} THEN l END) OVER (PARTITION BY chrom ORDER BY l, r, id ROWS UNBOUNDED PRECEDING) AS locus FROM reach)"""
_COV = f"""{_EV},
    ends AS (SELECT chrom, l AS p, 1 AS d FROM ev UNION ALL SELECT chrom, r, -1 FROM ev),
    steps AS (SELECT chrom, p, sum(d) AS d FROM ends GROUP BY ALL),
    depths AS (SELECT chrom, p AS l, lead(p) OVER w AS r, (sum(d) OVER w)::BIGINT AS depth FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY p)),
    cov AS (SELECT * FROM depths WHERE depth > 0)"""
_EDGES = """line AS (SELECT DISTINCT l_orderkey AS o, l_linenumber * 100 + least(4, floor(l_quantity / 11))::BIGINT AS v FROM lineitem),
    graphs AS (SELECT l_orderkey AS o, min('g' || l_returnflag || l_linestatus) AS g FROM lineitem GROUP BY 1),
    step AS (SELECT o, v AS s, lead(v) OVER (PARTITION BY o ORDER BY v) AS t, row_number() OVER (PARTITION BY o ORDER BY v) AS n FROM line),
    hop AS (SELECT g, s, coalesce(t, 10000) AS t FROM step JOIN graphs USING (o) UNION ALL SELECT g, 0, s FROM step JOIN graphs USING (o) WHERE n = 1),
    edges AS (SELECT g, s::BIGINT AS s, t::BIGINT AS t, count(*)::BIGINT AS w FROM hop GROUP BY ALL)"""
_RARE = f"""{_EDGES}, top AS (SELECT g, s, t, w FROM edges WHERE w >= (SELECT avg(w) FROM edges))"""
_CHAINS = """chains AS (SELECT l_orderkey AS o, string_agg(l_returnflag || l_linestatus, '-' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS chain, count(*)::BIGINT AS n, min(l_linenumber)::BIGINT AS l, max(l_linenumber)::BIGINT AS r, sum(l_quantity)::DOUBLE AS cov FROM lineitem GROUP BY 1)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_intervals(events: DataFrame) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(F.col("user_id").alias("chrom"), F.col("event_id").alias("id"), micros.alias("l"), (micros + (F.floor("value").cast("long") + 1) * 1_000_000).alias("r"), F.col("event_type").alias("ale"), "value")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _as_intervals(table(spark, d, "events"))


def _loci(spark: SparkSession, d: str) -> DataFrame:
    return intervals.sessionize(_events(spark, d), ["chrom"], gap=12 * HOUR, tie=("id",), width=DAY)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    vertex = F.col("l_linenumber").cast("long") * 100 + F.least(F.lit(4), F.floor(F.col("l_quantity") / 11)).cast("long")
    line = _lines(spark, d).select(F.col("l_orderkey").alias("o"), F.concat(F.lit("g"), "l_returnflag", "l_linestatus").alias("f"), vertex.alias("v"))
    return paths.edges_of_paths(line, "o", "v", "f", source=0, sink=10000)


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    """Edges of at least mean weight. All paths' edges together bring as much into each vertex as they take out, and have no dead ends; without the light ones they have what the queries on this graph are about."""
    edges = _edges(spark, d)
    return edges.join(F.broadcast(edges.agg(F.avg("w").alias("m"))), F.col("w") >= F.col("m")).drop("m")  # one row


def _chains(spark: SparkSession, d: str) -> DataFrame:
    return paths.chains(_lines(spark, d), "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus")).select(F.col("l_orderkey").alias("o"), "chain", "n", "l", "r", "cov")


@query(f"WITH {_LOCI} SELECT chrom, locus AS l, max(r) AS r, count(*)::BIGINT AS n FROM marked GROUP BY chrom, locus HAVING count(*) >= 5")
def q01_bundle_gap(spark: SparkSession, d: str) -> DataFrame:
    """Loci: runs of a user's intervals no more than twelve hours apart, of five or more."""
    return _loci(spark, d).groupBy("chrom", "locus").agg(F.max("r").alias("r"), F.count("*").alias("n")).where("n >= 5").select("chrom", F.col("locus").alias("l"), "r", "n")


@query("""WITH reads AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END) + (CASE WHEN l_linestatus = 'F' THEN 256 ELSE 0 END) AS flag, l_quantity, l_suppkey FROM lineitem)
    SELECT l_suppkey, count(*)::BIGINT AS n FROM reads WHERE flag & 4 = 0 AND flag & 256 = 0 AND l_quantity BETWEEN 1 AND 45 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0) GROUP BY 1""")  # fmt: skip
def q02_read_filter(spark: SparkSession, d: str) -> DataFrame:
    """Reads filtered by flag bits, a range, and a list of excluded sequences."""
    flag = F.when(F.col("l_returnflag") == "R", 4).otherwise(0) + F.when(F.col("l_linestatus") == "F", 256).otherwise(0)
    good = paths.read_filter(_lines(spark, d).withColumn("flag", flag), "flag", forbidden=4 | 256, between={"l_quantity": (1, 45)})
    excluded = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return good.join(excluded, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, strand, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS q FROM (SELECT l_suppkey, l_quantity, unnest(CASE l_returnflag WHEN 'R' THEN ['+'] WHEN 'A' THEN ['-'] ELSE ['+', '-'] END) AS strand FROM lineitem) GROUP BY ALL""")
def q02_strand_route(spark: SparkSession, d: str) -> DataFrame:
    """Reads without a strand go to both."""
    xs = F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(".")
    return paths.strand_route(_lines(spark, d).withColumn("xs", xs), "xs").groupBy("l_suppkey", "strand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query(f"WITH {_COV} SELECT chrom, l, r, depth FROM cov")
def q03_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Depth of coverage, split at every end."""
    return intervals.coverage(_events(spark, d), ["chrom"], width=DAY)


@query(f"""WITH {_COV}, days AS (SELECT DISTINCT chrom, l // {DAY} * {DAY} AS rl, l // {DAY} * {DAY} + {DAY} AS rr FROM ev),
    part AS (SELECT days.*, greatest(l, rl) AS a, least(r, rr) AS b, depth FROM days JOIN cov USING (chrom) WHERE l < rr AND r > rl),
    sums AS (SELECT chrom, rl, rr, sum(depth * (b - a)) AS s1, sum(depth * depth * (b - a)) AS s2, sum(b - a) AS c, max(depth) AS high FROM part GROUP BY ALL)
    SELECT chrom, rl, rr, round(coalesce(s1 / (rr - rl), 0), 6) AS ave, round(coalesce(sqrt(greatest((s2 - 2 * (s1 / (rr - rl)) * s1 + (s1 / (rr - rl)) * (s1 / (rr - rl)) * c) / (rr - rl), 0)), 1), 6) AS dev, high FROM days LEFT JOIN sums USING (chrom, rl, rr)""")  # fmt: skip
def q03_region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and largest depth of each user's days."""
    ev = _events(spark, d)
    days = ev.select("chrom", (F.floor(F.col("l") / DAY) * DAY).alias("rl")).distinct().withColumn("rr", F.col("rl") + DAY)
    stats = intervals.region_stats(days, intervals.coverage(ev, ["chrom"], width=DAY), ["chrom"], width=DAY)
    return stats.select("chrom", "rl", "rr", F.round("ave", 6).alias("ave"), F.round("dev", 6).alias("dev"), "high")


@query(f"""WITH {_EV}, reach AS (SELECT *, max(r) OVER (PARTITION BY ale ORDER BY l, r, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
    marked AS (SELECT *, max(CASE WHEN m IS NULL OR l > m + 60000000 THEN l END) OVER (PARTITION BY ale ORDER BY l, r, id ROWS UNBOUNDED PRECEDING) AS locus FROM reach)
    SELECT ale, locus AS l, max(r) AS r, count(*)::BIGINT AS n FROM marked GROUP BY ale, locus""")
def q03_coalesced(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each type's intervals up to a minute apart; few keys, so the work is divided by bins."""
    return intervals.coalesced(_events(spark, d), ["ale"], gap=60_000_000, width=DAY)


@query(f"""WITH {_EV} SELECT p.ale AS ale, i.ale AS within, count(*)::BIGINT AS n, count(DISTINCT p.id)::BIGINT AS points FROM ev p JOIN ev i ON p.chrom = i.chrom AND i.l <= p.l AND p.l < i.r AND p.id <> i.id GROUP BY ALL""")
def q04_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Points in intervals: starts of a user's events while another event of the user lasts."""
    ev = _events(spark, d)
    points, spans = ev.select("chrom", F.col("id").alias("pid"), F.col("ale"), F.col("l").alias("p")), ev.select("chrom", "id", F.col("ale").alias("within"), "l", "r")
    return intervals.points_in_intervals(points, spans, ["chrom"], width=HOUR // 4).where("pid <> id").groupBy("ale", "within").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("points"))


@query(f"""WITH {_EV}, a AS (SELECT chrom, id, l FROM ev WHERE ale = 'purchase'), b AS (SELECT chrom, l, max(id) AS view FROM ev WHERE ale = 'view' GROUP BY ALL)
    SELECT a.chrom, a.id, a.l, coalesce(b.view, -1) AS view FROM a ASOF LEFT JOIN b ON a.chrom = b.chrom AND a.l >= b.l""")
def q04_asof_region(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    ev = _events(spark, d)
    return intervals.asof(ev.where("ale = 'purchase'").select("chrom", "id", "l"), ev.where("ale = 'view'").select("chrom", "l", F.col("id").alias("view")), ["chrom"], "l", ["view"], width=DAY).fillna(-1, ["view"])


@query(f"""WITH {_EV}, pair AS (SELECT ale AS a, value AS v, lead(ale) OVER w AS b, lead(value) OVER w AS u FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY l, id))
    SELECT a, b, count(*)::BIGINT AS n, CASE WHEN bool_or(u > v) = bool_or(u <= v) THEN '.' WHEN bool_or(u > v) THEN '+' ELSE '-' END AS strand FROM pair WHERE b IS NOT NULL GROUP BY a, b""")
def q05_junction_count(spark: SparkSession, d: str) -> DataFrame:
    """Counts of neighbouring pairs, with the sign that all agree on."""
    ev = _events(spark, d).withColumn("_bin", F.floor(F.col("l") / DAY))
    pairs = intervals.following(ev, ["chrom"], "_bin", ["l", "id"], F.struct("ale", "value"), "next").where("next is not null")
    return paths.junctions(pairs.select(F.col("ale").alias("a"), F.col("next.ale").alias("b"), (F.col("next.value") > F.col("value")).alias("plus")))


@query("""WITH votes AS (SELECT l_partkey AS part, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)::BIGINT AS n1, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END)::BIGINT AS n2 FROM lineitem GROUP BY 1)
    SELECT part, n1, n2, CASE WHEN n1 > (n1 + n2) * 0.75 THEN 'ALLELE1' WHEN n2 > (n1 + n2) * 0.75 THEN 'ALLELE2' ELSE 'UNPHASED' END AS gt FROM votes""")
def q06_allele_class(spark: SparkSession, d: str) -> DataFrame:
    """Votes of distinct orders for one of two alleles, by a strict three quarters."""
    return paths.allele_votes(_lines(spark, d).select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("voter"), F.col("l_returnflag").alias("f")), "part", "voter", F.col("f") == "R", F.col("f") == "A")


@query("""SELECT l_returnflag, coalesce(p_brand, 'N') AS allele, count(*)::BIGINT AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey GROUP BY ALL""")
def q07_allele_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sites without a known allele count as N."""
    sites = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("allele"))
    return paths.filled(_lines(spark, d), sites, ["l_partkey"], {"allele": "N"}).groupBy("l_returnflag", "allele").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_partkey, l_quantity, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem WHERE l_returnflag IN ('R', 'A'))
    SELECT a.l_orderkey AS left_order, a.l_linenumber::BIGINT AS left_line, b.l_orderkey AS right_order, b.l_linenumber::BIGINT AS right_line FROM x a JOIN x b USING (l_partkey, l_quantity, nth) WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'""")
def q08_mate_pair(spark: SparkSession, d: str) -> DataFrame:
    """Mates by equal keys, each used once, first come first served."""
    line = _lines(spark, d).select("l_partkey", "l_quantity", "l_returnflag", F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"))
    left, right = (line.where(F.col("l_returnflag") == f).select("l_partkey", "l_quantity", F.col("o").alias(f"{n}_order"), F.col("k").alias(f"{n}_line")) for f, n in (("R", "left"), ("A", "right")))
    return paths.mates(left, right, ["l_partkey", "l_quantity"], ["left_order", "left_line"], ["right_order", "right_line"]).drop("l_partkey", "l_quantity")


@query(f"WITH {_CHAINS} SELECT chain, count(*)::BIGINT AS n FROM chains WHERE n >= 2 GROUP BY chain")
def q09_hyper_paths(spark: SparkSession, d: str) -> DataFrame:
    """Counts of equal paths of two or more steps."""
    return _chains(spark, d).where("n >= 2").groupBy("chain").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_returnflag || l_linestatus AS a, lead(l_returnflag || l_linestatus) OVER w AS b, lead(l_returnflag || l_linestatus, 2) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus))
    SELECT a || '-' || b || '-' || c AS kmer, count(*)::BIGINT AS n FROM x WHERE c IS NOT NULL GROUP BY 1""")
def q09_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the windows of three steps of all paths."""
    return paths.kmers(_chains(spark, d).withColumn("path", F.split("chain", "-")), "path", 3)


#: Each round, a node takes the least label beside it; 40 rounds are far more than the graph of orders and parts is wide.
_COMPONENTS = """edge AS (SELECT DISTINCT l_orderkey AS a, -l_partkey AS b FROM lineitem), sides AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge UNION ALL SELECT a, a FROM edge UNION ALL SELECT b, b FROM edge),
    label(node, component, k) AS (SELECT DISTINCT a, a, 0 FROM sides UNION ALL (SELECT s.a, min(component), any_value(k) + 1 FROM label JOIN sides s ON s.b = node WHERE k < 40 GROUP BY s.a)),
    found AS (SELECT node, component FROM label WHERE k = 40)"""


def _order_parts(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM found")
def q10_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the graph of all orders and the parts that they buy."""
    return graph.connected_components(_order_parts(spark, d))


@query(f"WITH RECURSIVE {_COMPONENTS}, lines AS (SELECT component, count(*)::BIGINT AS lines FROM lineitem JOIN found ON node = l_orderkey GROUP BY 1) SELECT component, count(*)::BIGINT AS nodes, any_value(lines) AS lines FROM found JOIN lines USING (component) GROUP BY 1")
def q10_components_all(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of those components: their nodes, and the lines among them."""
    found = graph.connected_components(_order_parts(spark, d))
    lines = _lines(spark, d).groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("lines"))
    return found.join(lines, "node", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.sum("lines").alias("lines"))


@query("""SELECT l_orderkey AS o, count(*)::BIGINT AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY 1 HAVING count(p_partkey) = count(*)""")
def q10_subgraph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths all of whose vertices are in a part of the graph."""
    inside = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("v"))
    return paths.wholly_inside(_lines(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v")), inside, "o", "v")


@query(f"""WITH RECURSIVE {_RARE}, down(g, v) AS (SELECT DISTINCT g, 0::BIGINT FROM top UNION SELECT e.g, e.t FROM down d JOIN top e ON e.g = d.g AND e.s = d.v),
    up(g, v) AS (SELECT DISTINCT g, 10000::BIGINT FROM top UNION SELECT e.g, e.s FROM up d JOIN top e ON e.g = d.g AND e.t = d.v)
    SELECT e.g, e.s, e.t, e.w FROM top e SEMI JOIN down a ON a.g = e.g AND a.v = e.s SEMI JOIN up b ON b.g = e.g AND b.v = e.t""")
def q11_dead_end_prune(spark: SparkSession, d: str) -> DataFrame:
    """Edges of at least mean weight, without those on no way from source to sink."""
    return graph.prune_dead_ends(_heavy(spark, d), 0, 10000, ["g"])


@query(f"""WITH RECURSIVE {_EDGES}, best(g, v, b) AS (SELECT DISTINCT g, 0::BIGINT, 9223372036854775807::BIGINT FROM edges UNION SELECT e.g, e.t, least(b, w) FROM best JOIN edges e ON e.g = best.g AND e.s = best.v)
    SELECT g, v, max(b) AS b FROM best GROUP BY ALL""")
def q12_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    """The widest way from the source to each vertex: the largest least weight."""
    return graph.relaxed(_edges(spark, d), 0, ["g"], F.lit((1 << 63) - 1).cast("long"), F.least, F.max, "b")


@query(f"""WITH RECURSIVE {_EDGES}, ways(g, v, n, k) AS (SELECT DISTINCT g, 0::BIGINT, 1::HUGEINT, 0 FROM edges UNION ALL (SELECT e.g, e.t, sum(n)::HUGEINT, any_value(k) + 1 FROM ways JOIN edges e ON e.g = ways.g AND e.s = ways.v GROUP BY e.g, e.t))
    SELECT g, v, sum(n)::BIGINT AS n FROM ways GROUP BY ALL""")
def q12_path_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of ways from the source to each vertex."""
    return graph.path_counts(_edges(spark, d), 0, ["g"])


@query(f"""WITH RECURSIVE {_EDGES}, best(g, v, c) AS (SELECT DISTINCT g, 0::BIGINT, 0::BIGINT FROM edges UNION (SELECT e.g, e.t, min(c + w)::BIGINT FROM best JOIN edges e ON e.g = best.g AND e.s = best.v GROUP BY e.g, e.t))
    SELECT g, v, min(c) AS c FROM best GROUP BY ALL""")
def q12_shortest(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest way from the source to each vertex, weights added up."""
    return graph.relaxed(_edges(spark, d), 0, ["g"], F.lit(0).cast("long"), lambda a, w: a + w, F.min, "c")


@query(f"""WITH {_EDGES}, ends AS (SELECT g, s AS v, t AS o, w, 0 AS i FROM edges UNION ALL SELECT g, t, s, w, 1 FROM edges)
    SELECT g, v, count(*) FILTER (i = 1)::BIGINT AS n_in, count(*) FILTER (i = 0)::BIGINT AS n_out, coalesce(sum(w) FILTER (i = 1), 0)::BIGINT AS w_in, coalesce(sum(w) FILTER (i = 0), 0)::BIGINT AS w_out, arg_max(o, w * 100000 - o) AS best FROM ends GROUP BY g, v""")
def q13_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees, weights and heaviest neighbour of each vertex."""
    return graph.degrees(_edges(spark, d), ["g"])


@query("""WITH x AS (SELECT l_returnflag || l_linestatus AS a, lead(l_returnflag || l_linestatus) OVER w AS v, lead(l_returnflag || l_linestatus, 2) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus))
    SELECT v, a, b, count(*)::BIGINT AS support FROM x WHERE b IS NOT NULL GROUP BY ALL""")
def q13_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many paths support each pair of an edge into a vertex and one out of it."""
    return paths.routes(_chains(spark, d).withColumn("path", F.split("chain", "-")), "path")


@query("""WITH h AS (SELECT l_quantity::BIGINT AS x, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM h)
    SELECT min(x) FILTER (upto >= 0.5 * total) AS median, min(x) FILTER (upto >= 0.005 * total) AS low, min(x) FILTER (upto >= 0.998 * total) AS high, round((sum(x * n) FILTER (upto - n < 0.999 * total))::DOUBLE / (sum(n) FILTER (upto - n < 0.999 * total))::DOUBLE, 6) AS mean FROM c""")
def q14_insert_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, tails and trimmed mean of a histogram."""
    return paths.histogram_profile(_lines(spark, d).select(F.col("l_quantity").cast("long").alias("x")), "x")


@query("""WITH x AS (SELECT l_returnflag = l_linestatus OR l_returnflag = 'A' AS agrees, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, l_linestatus AS s FROM lineitem),
    per AS (SELECT s, count(*) AS n FROM x GROUP BY s), most AS (SELECT least(50000, min(n)) AS m FROM per)
    SELECT s, count(*)::BIGINT AS n, count(*) FILTER (agrees)::BIGINT AS agree FROM x, most WHERE nth <= m GROUP BY s""")
def q14_strandness(spark: SparkSession, d: str) -> DataFrame:
    """As many reads of each sign, up to 50,000, and how many of them agree: the sample is the feature."""
    line = _lines(spark, d).select(F.col("l_linestatus").alias("s"), ((F.col("l_returnflag") == F.col("l_linestatus")) | (F.col("l_returnflag") == "A")).alias("agrees"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"))
    return paths.balanced_sample(line, "s", "place", 50_000).groupBy("s").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agree"))


@query("""WITH x AS (SELECT *, lag(p_retailprice) OVER w AS before FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey)),
    y AS (SELECT *, sum(CASE WHEN before IS NULL OR p_retailprice - before > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS c FROM x)
    SELECT p_brand, p_type, c::BIGINT AS c, count(*)::BIGINT AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM y GROUP BY ALL""")
def q15_flank_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of rows within 30 of the one before."""
    return paths.clusters(table(spark, d, "part"), ["p_brand", "p_type"], "p_retailprice", ["p_partkey"], 30, width=200).groupBy("p_brand", "p_type", "c").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query(f"""WITH {_CHAINS} SELECT chain, count(*)::BIGINT AS n, sum(cov) AS cov_add, max(cov) AS cov_max, min(cov) AS cov_min, arg_min(cov, o) AS cov_first, min(l) AS l, max(r) AS r FROM chains GROUP BY chain""")
def q16_transcript_merge(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of equal chains merged, with coverage added, largest, smallest, or the first one's."""
    return paths.merged(_chains(spark, d), ["chain"], "o", "cov")


@query(f"""WITH {_CHAINS}, a AS (SELECT * FROM chains SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o = o_orderkey), b AS (SELECT * FROM chains ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o = o_orderkey)
    SELECT o, chain, CASE WHEN chain IN (SELECT chain FROM b) THEN 'NONSPECIFIC' ELSE 'ALLELE1' END AS gt FROM a UNION ALL SELECT o, chain, CASE WHEN chain IN (SELECT chain FROM a) THEN 'NONSPECIFIC' ELSE 'ALLELE2' END FROM b""")
def q17_specific(spark: SparkSession, d: str) -> DataFrame:
    """Chains of one allele that the other has not."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    rows = _chains(spark, d).select("o", "chain")
    return paths.specific(rows.join(done, "o", "left_semi"), rows.join(done, "o", "left_anti"), ["chain"])


_WEEKS = f"""{_LOCI}, exon AS (SELECT chrom, locus // {7 * DAY} AS wk, locus AS l, max(r) AS r, count(*)::BIGINT AS n FROM marked GROUP BY chrom, locus),
    t AS (SELECT chrom || '.' || wk AS id, min(l) AS l, max(r) AS r, sum(n)::BIGINT AS n FROM exon GROUP BY ALL),
    gaps AS (SELECT * FROM (SELECT chrom || '.' || wk AS id, r AS gl, lead(l) OVER (PARTITION BY chrom, wk ORDER BY l) AS gr FROM exon) WHERE gr IS NOT NULL)"""


def _weeks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    exon = _loci(spark, d).groupBy("chrom", "locus").agg(F.max("r").alias("r"), F.count("*").alias("n")).withColumn("wk", F.floor(F.col("locus") / (7 * DAY))).withColumn("id", F.concat_ws(".", "chrom", "wk"))
    gaps = exon.withColumn("gr", F.lead("locus").over(Window.partitionBy("id").orderBy("locus"))).where("gr is not null").select(F.lit(0).alias("all"), "id", F.col("r").alias("gl"), "gr")
    return exon.groupBy("id").agg(F.min("locus").alias("l"), F.max("r").alias("r"), F.sum("n").alias("n")).withColumn("all", F.lit(0)), gaps


@query(f"""WITH {_WEEKS} SELECT id, l, r, n FROM t WHERE NOT EXISTS (SELECT 1 FROM gaps g, t u WHERE g.id = t.id AND u.id <> t.id AND g.gl < u.l AND u.r < g.gr AND u.n >= t.n)""")
def q18_nested_remove(spark: SparkSession, d: str) -> DataFrame:
    """A user's weeks without those that have another of as many events inside a gap."""
    weeks, gaps = _weeks(spark, d)
    return intervals.not_nesting(weeks, gaps, ["all"], "id", "n", width=6 * HOUR).select("id", "l", "r", "n")


@query(f"""WITH {_CHAINS} SELECT o, n, cov FROM chains WHERE cov >= 10 + 5 * n AND (CASE WHEN n = 1 THEN cov >= 20 ELSE cov >= 1.5 END)""")
def q18_length_cov_filter(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts long enough for their exons and covered enough."""
    return paths.length_coverage_filter(_chains(spark, d), "cov", "n", "cov", base=10, per_exon=5, single=20, multi=1.5).select("o", "n", "cov")


@query("""WITH votes AS (SELECT l_partkey AS part, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)::BIGINT AS n1, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END)::BIGINT AS n2, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
    SELECT part, round(CASE WHEN n1 + n2 = 0 THEN -1 ELSE w * ((n1 + 0.01::DOUBLE) / (n1 + n2 + 0.02::DOUBLE)) END, 6) AS w1, round(CASE WHEN n1 + n2 = 0 THEN -1 ELSE w * ((n2 + 0.01::DOUBLE) / (n1 + n2 + 0.02::DOUBLE)) END, 6) AS w2 FROM votes""")
def q19_phase_split(spark: SparkSession, d: str) -> DataFrame:
    """Weights divided between two alleles by their votes, with a little for each."""
    line = _lines(spark, d)
    votes = paths.allele_votes(line.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("voter"), F.col("l_returnflag").alias("f")), "part", "voter", F.col("f") == "R", F.col("f") == "A")
    weights = line.groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("w"))
    return paths.phase_split(votes.join(weights, "part"), "n1", "n2", "w").select("part", F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"))


@query("""WITH x AS (SELECT p_partkey, translate(upper(p_name), 'BDEFHIJKLMOPQRSUVWXYZ 0123456789#-_', '') AS dna, p_size FROM part)
    SELECT p_partkey, reverse(translate(dna, 'ACGTN', 'TGCAN')) AS rc, length(dna)::BIGINT AS n FROM x""")
def q20_revcomp(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements of the bases in part names."""
    from ..functions.alignment import reverse_complement

    dna = F.translate(F.upper("p_name"), "BDEFHIJKLMOPQRSUVWXYZ 0123456789#-_", "")
    return table(spark, d, "part").select("p_partkey", reverse_complement(dna).alias("rc"), F.length(dna).cast("long").alias("n"))


@query("""WITH x AS (SELECT l_orderkey AS o, l_linenumber AS k, l_returnflag AS f, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)),
    y AS (SELECT o, f, min(k)::BIGINT AS start, count(*)::BIGINT AS len FROM x GROUP BY o, f, run) SELECT * FROM y""")
def q20_rle(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive lines with one flag, as (start, length) codes."""
    from ..functions.alignment import run_length

    runs = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("f")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("v"))
    return runs.select("o", "f", F.explode(run_length("v")).alias("x")).select("o", "f", "x.start", "x.len")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A')
    SELECT coalesce(a.s, b.s) AS s, count(a.p + b.p)::BIGINT AS tp, (count(a.p) - count(a.p + b.p))::BIGINT AS fn, (count(b.p) - count(a.p + b.p))::BIGINT AS fp FROM a FULL JOIN b ON a.p = b.p AND a.s = b.s GROUP BY 1""")
def q21_graph_diff(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries that two sets share, and those of one alone."""
    a, b = (_lines(spark, d).where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")) for f in "RA")
    return paths.set_difference_counts(a, b, ["p", "s"], ["s"])


_GTF = """chrom || chr(9) || 'braidline' || chr(9) || f || chr(9) || (a + 1) || chr(9) || b || chr(9) || '1000' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id "' || id || '"; transcript_id "' || id || '.0";'"""


@query(f"""WITH {_WEEKS}, rows AS (SELECT split_part(id, '.', 1) AS chrom, id, 'transcript' AS f, l AS a, r AS b, n FROM t UNION ALL SELECT chrom::VARCHAR, chrom || '.' || wk, 'exon', l, r, n FROM exon)
    SELECT id, {_GTF} || CASE WHEN f = 'transcript' THEN ' cov "' || n || '";' ELSE '' END AS line FROM rows""")
def q22_gtf_rows(spark: SparkSession, d: str) -> DataFrame:
    """A user's weeks as transcript and exon lines."""
    from ..sources.gtf import gtf_lines

    exon = _loci(spark, d).groupBy("chrom", "locus").agg(F.max("r").alias("r"), F.count("*").alias("n"))
    exon = exon.withColumn("id", F.concat_ws(".", "chrom", F.floor(F.col("locus") / (7 * DAY))))
    weeks = exon.groupBy("id", F.col("chrom").cast("string").alias("seqname")).agg(F.sort_array(F.collect_list(F.struct(F.col("locus").alias("l"), "r"))).alias("exons"), F.sum("n").cast("string").alias("cov"))
    return gtf_lines(weeks, gene="id", transcript=F.concat("id", F.lit(".0")), seqname="seqname", strand=F.lit("+"), exons="exons", cov="cov", source="braidline").select("id", "line")


@query(f"""WITH {_EDGES}, side AS (SELECT *, max(w) OVER (PARTITION BY g, s) AS ws, max(w) OVER (PARTITION BY g, t) AS wt FROM edges)
    SELECT g, s, t, w FROM side WHERE NOT (ws >= 2 * w * w + 18 AND wt >= 2 * w * w + 18)""")
def q23_small_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are not dwarfed on both sides."""
    return paths.without_small_edges(_edges(spark, d), ["g"])


@query(f"""WITH {_EDGES}, side AS (SELECT *, max(w) OVER (PARTITION BY g, s) AS ws, max(w) OVER (PARTITION BY g, t) AS wt FROM edges) SELECT g, s, t, w FROM side WHERE w <= 0.05 * greatest(ws, wt)""")
def q24_negligible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of at most a twentieth of the heaviest beside them."""
    return paths.negligible_edges(_edges(spark, d), ["g"], 0.05)


@query(f"""WITH {_RARE}, i AS (SELECT g, t AS v, sum(w)::DOUBLE AS a FROM top GROUP BY ALL), o AS (SELECT g, s AS v, sum(w)::DOUBLE AS b FROM top GROUP BY ALL),
    x AS (SELECT *, sqrt(b / a) AS r FROM i JOIN o USING (g, v))
    SELECT e.g, e.s, e.t, round(e.w * coalesce(x.r, 1) , 6) AS balanced FROM top e LEFT JOIN x ON x.g = e.g AND x.v = e.t""")
def q25_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights into each inner vertex scaled half way, geometrically, to those out of it."""
    return paths.balanced_in_weights(_heavy(spark, d), ["g"]).select("g", "s", "t", F.round("balanced", 6).alias("balanced"))


@query(f"""WITH {_RARE}, i AS (SELECT g, t AS v, sum(w) AS a FROM top GROUP BY ALL), o AS (SELECT g, s AS v, sum(w) AS b FROM top GROUP BY ALL)
    SELECT g, v, CASE WHEN a > b THEN 10000 ELSE 0 END::BIGINT AS via, abs(a - b)::BIGINT AS w FROM i JOIN o USING (g, v) WHERE greatest(a, b) >= 1.25 * least(a, b)""")
def q26_extend_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """New edges to source or sink where a vertex gets, or gives, a quarter more than it passes on."""
    return paths.boundary_edges(_heavy(spark, d), ["g"], 0, 10000, 1.25)


@query("""SELECT l_suppkey, round(sum(l_quantity) * 1e9 / (SELECT sum(l_quantity * l_linenumber) FROM lineitem), 4) AS rpkm FROM lineitem GROUP BY 1""")
def q27_rpkm(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by total length."""
    return paths.rpkm(_lines(spark, d), "l_suppkey", F.col("l_quantity"), F.col("l_quantity") * F.col("l_linenumber")).withColumn("rpkm", F.round("rpkm", 4))


@query()
def q28_decompose(spark: SparkSession, d: str) -> DataFrame:
    """Greedy decomposition of the graphs into weighted ways from source to sink."""
    return paths.decomposed(_edges(spark, d), ["g"], 0, 10000, least=1.5)


@query(f"WITH {_LOCI} SELECT chrom, locus AS l, max(r) AS r, count(*)::BIGINT AS n FROM marked GROUP BY chrom, locus")
def q29_stream_loci(spark: SparkSession, d: str) -> DataFrame:
    """Loci of the events as a stream, all that is there in one go."""
    from ..runtime import shared_dir
    from ..streaming.loci import stream_loci

    # by a pattern, as a stream's path may not be one file
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    made, seen = shared_dir(spark), shared_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(made)

    loci = stream_loci(_as_intervals(stream).select("chrom", "l", "r"), 12 * HOUR)
    loci.writeStream.outputMode("complete").option("checkpointLocation", seen).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(loci.schema).parquet(made)
