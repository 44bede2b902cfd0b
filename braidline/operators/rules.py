"""Rules on the vertices of splice graphs, each for all graphs at once.

Vertices: (keys, v, l, r, ale, gt, weight, dev, ltype, rtype, empty); edges: (keys, s, t, w), with 0 for the start and no
vertex for it or for the end. No rule looks at empty vertices, unless surroundings() that hold them are given as around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import connected_components, with_heaviest_ways
from .intask import MOST_ROWS, by_size, ends_of, in_tasks
from .regions import END, LEAST_WEIGHT, PLAIN, START

#: The two alleles' names.
ALLELES = ("ALLELE1", "ALLELE2")
#: The least weights of edges that survive by themselves, and as the heaviest of a component.
LEAST_SURVIVING, LEAST_HEAVIEST = 1.6, 1.5


def surroundings(vertices: DataFrame, edges: DataFrame, keys: list[str], empty: bool = False) -> DataFrame:
    """The vertices that are not empty (with empty, those too) and have edges, with n_in, n_out, w_in, w_out, the least vertex before and after, whether they are joined to the start and to the end, and whether a neighbour touches them on the left and on the right."""
    side = lambda v, place, out: vertices.select(*keys, F.col("v").alias(v), F.col(place).alias(out))
    ends = edges.join(side("s", "r", "s_r"), [*keys, "s"], "left").join(side("t", "l", "t_l"), [*keys, "t"], "left")
    touch = F.coalesce(F.bool_or(F.col("s_r") == F.col("t_l")), F.lit(False))
    into = ends.groupBy(*keys, F.col("t").alias("v")).agg(F.count("*").alias("n_in"), F.sum("w").alias("w_in"), F.min("s").alias("before"), F.bool_or(F.col("s") == 0).alias("starts"), touch.alias("flush_left"))
    out = ends.groupBy(*keys, F.col("s").alias("v")).agg(F.count("*").alias("n_out"), F.sum("w").alias("w_out"), F.min("t").alias("after"), F.bool_or(F.col("t_l").isNull()).alias("ends"), touch.alias("flush_right"))
    rows = (vertices if empty else vertices.where("not empty")).join(into, [*keys, "v"], "left").join(out, [*keys, "v"], "left").where("n_in is not null or n_out is not null")
    return rows.fillna(0, ["n_in", "n_out", "w_in", "w_out"]).fillna(False, ["starts", "ends", "flush_left", "flush_right"])


def inner_boundaries(vertices: DataFrame, edges: DataFrame, keys: list[str], least_dev: float = 0.01, around: DataFrame | None = None) -> DataFrame:
    """Plain vertices of even depth, with one edge in and one out, of which one is to an end and the other is not its neighbour's only one."""
    around = around or cut(surroundings(vertices, edges, keys))
    one = around.where((F.col("ale") == PLAIN) & (F.col("dev") < least_dev)).where("n_in = 1 and n_out = 1 and (starts or ends)")
    degree = lambda v, end: edges.groupBy(*keys, F.col(end).alias(v)).agg(F.count("*").alias(f"{v}_n"))  # noqa: E731  of all edges, those of empty vertices included
    rows = one.join(degree("before", "s"), [*keys, "before"], "left").join(degree("after", "t"), [*keys, "after"], "left")
    return rows.where("(starts or before_n > 1) and (ends or after_n > 1)").select(*keys, "v")


def small_exons(vertices: DataFrame, edges: DataFrame, keys: list[str], least_length: int = 20, around: DataFrame | None = None) -> DataFrame:
    """Short vertices that no neighbour touches and that are joined to an end."""
    return (around or surroundings(vertices, edges, keys)).where(F.col("r") - F.col("l") < least_length).where("not flush_left and not flush_right and (starts or ends)").select(*keys, "v")


def contaminated_introns(vertices: DataFrame, edges: DataFrame, keys: list[str], most: float = 2.0, around: DataFrame | None = None) -> DataFrame:
    """Vertices between two that touch them, with no other edges, of at most the weight of the edge that leads past them, and at most so much."""
    rows = (around or surroundings(vertices, edges, keys)).where("n_in = 1 and n_out = 1 and not starts and not ends and flush_left and flush_right").where(F.col("weight") <= most)
    past = edges.select(*keys, F.col("s").alias("before"), F.col("t").alias("after"), F.col("w").alias("past"))
    return rows.join(past, [*keys, "before", "after"]).where("weight <= past").select(*keys, "v")


def extended_boundaries(vertices: DataFrame, edges: DataFrame, keys: list[str], square: float = 10, more: float = 10, around: DataFrame | None = None) -> DataFrame:
    """(keys, v, side, w): plain vertices not joined to the start (end) whose weight is at least that of their edges in (out), and so many times its square and so much more, with the difference."""
    around = (around or cut(surroundings(vertices, edges, keys))).where(F.col("ale") == PLAIN)
    side = lambda name, joined, w: around.where(~F.col(joined)).where((F.col("weight") >= F.col(w)) & (F.col("weight") >= square * F.col(w) * F.col(w) + more)).select(*keys, "v", F.lit(name).alias("side"), (F.col("weight") - F.col(w)).alias("w"))
    return side("start", "starts", "w_in").union(side("end", "ends", "w_out"))


def _with_ends(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges between vertices, with where these end and begin, their alleles and weights."""
    for c, place in (("s", "r"), ("t", "l")):
        edges = edges.join(vertices.select(*keys, F.col("v").alias(c), F.col(place).alias(f"{c}_{place}"), F.col("ale").alias(f"{c}_ale"), F.col("weight").alias(f"{c}_weight")), [*keys, c])
    return edges


def small_junctions(vertices: DataFrame, edges: DataFrame, keys: list[str], square: float = 2, more: float = 18) -> DataFrame:
    """(keys, s, t, w): edges dwarfed at one of their vertices.

    That vertex, and the heaviest plain one that touches it on the edge's side, both weigh at least so many times the
    square of the edge's weight and so much more; the edge itself is not one that leads to such a neighbour.
    """
    ends = _with_ends(vertices, edges, keys)
    bar = square * F.col("w") * F.col("w") + more
    beside = {}
    for c, o in ("st", "ts"):  # c is the neighbour, o the vertex
        touches = (F.col("s_r") == F.col("t_l")) & (F.col(f"{c}_ale") == PLAIN)
        heaviest = ends.where(touches).groupBy(*keys, o).agg(F.max(f"{c}_weight").alias(f"{c}_beside"))
        beside[c] = heaviest, ~touches & (F.col(f"{c}_beside") >= bar) & (F.col(f"{o}_weight") >= bar)
    rows = ends.join(beside["s"][0], [*keys, "t"], "left").join(beside["t"][0], [*keys, "s"], "left")
    return rows.where(beside["s"][1] | beside["t"][1]).select(*keys, "s", "t", "w")


def weak_junctions(vertices: DataFrame, edges: DataFrame, keys: list[str], square: float = 10, more: float = 10) -> DataFrame:
    """(keys, s, t, to_end, from_start): junctions that are the only edge of a vertex that weighs at least so many times their weight's square and so much more, with the weights of the edges to the end and from the start that replace them (null: none)."""
    ends = _with_ends(vertices, edges, keys).where(F.col("s_r") < F.col("t_l"))
    for c in "st":
        ends = ends.join(edges.groupBy(*keys, c).agg(F.count("*").alias(f"{c}_n")), [*keys, c])
    bar = square * F.col("w") * F.col("w") + more
    only = {c: F.when(F.col(f"{c}_n") == 1, F.col(f"{c}_weight")) for c in "st"}
    rows = ends.where((only["s"] >= bar) | (only["t"] >= bar))
    return rows.select(*keys, "s", "t", only["s"].alias("to_end"), only["t"].alias("from_start"))


def vertex_classes(vertices: DataFrame, edges: DataFrame, loci: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, class, regional): allelic vertices, those beside them, and others; regional are those that begin and end inside the locus (keys, l, r)."""
    allelic = vertices.where(F.col("ale") != PLAIN).select(*keys, "v")
    beside = edges.join(allelic.withColumnRenamed("v", "s"), [*keys, "s"]).select(*keys, F.col("t").alias("v")).union(edges.join(allelic.withColumnRenamed("v", "t"), [*keys, "t"]).select(*keys, F.col("s").alias("v")))
    rows = vertices.join(beside.distinct().withColumn("_beside", F.lit(True)), [*keys, "v"], "left").join(loci.select(*keys, F.col("l").alias("_l"), F.col("r").alias("_r")), keys)
    both = (F.col("ltype").bitwiseAND(F.lit(START)) > 0) & (F.col("rtype").bitwiseAND(F.lit(END)) > 0)
    return rows.select(*keys, "v", F.when(F.col("ale") != PLAIN, "allelic").when(F.col("_beside"), "adjacent").otherwise("ordinary").alias("class"), (both & ((F.col("l") != F.col("_l")) | (F.col("r") != F.col("_r")))).alias("regional"))


def without_regional_graphs(classes: DataFrame, keys: list[str]) -> DataFrame:
    """The graphs (keys) that have a vertex that is not regional."""
    return classes.groupBy(*keys).agg(F.bool_and("regional").alias("_all")).where("not _all").select(*keys)


def counter_alleles(sites: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r, ale, gt, weight): of sites (keys, l, r, ale, gt) where one of the two alleles was seen, the other that is known there (keys, l, ale, gt), with the least weight."""
    one = sites.where(F.col("gt").isin(*ALLELES)).groupBy(*keys, "l", "r").agg(F.min("gt").alias("seen"), F.count_distinct("gt").alias("n")).where("n = 1")
    return one.join(known.where(F.col("gt").isin(*ALLELES)), [*keys, "l"]).where("gt <> seen").select(*keys, "l", "r", "ale", "gt", F.lit(LEAST_WEIGHT).alias("weight"))


def lone_alleles(sites: DataFrame, keys: list[str], most: float = 3) -> DataFrame:
    """Alleles (keys, l, r, ale, gt, n) of little depth at sites where the other was not seen: these tell nothing."""
    alone = F.count("*").over(Window.partitionBy(*keys, "l", "r"))  # a site has at most the two
    return sites.where(F.col("gt").isin(*ALLELES)).withColumn("_of", alone).where((F.col("_of") == 1) & (F.col("n") <= most)).drop("_of")


def transcripts(ways: DataFrame, parts: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, id, gt, exons) of ways (keys, id, way) through parts (keys, pid, l, r, ale, gt): parts that touch are one exon.

    The genotype is the first allele's; without one it is NONSPECIFIC if any part is, else UNPHASED.
    """
    steps = ways.select(*keys, id_, F.posexplode("way").alias("k", "pid")).join(parts.select(*keys, "pid", "l", "r", "gt"), [*keys, "pid"])
    allele = F.col("gt").isin(*ALLELES)
    first = F.min_by(F.when(allele, F.col("gt")), F.when(allele, F.col("k")))
    own = steps.groupBy(*keys, id_).agg(F.coalesce(first, F.when(F.bool_or(F.col("gt") == "NONSPECIFIC"), "NONSPECIFIC")).alias("gt"), F.array_sort(F.collect_set(F.struct("l", "r"))).alias("x"))
    # a part that begins where the last exon ends goes on with it
    joined = F.expr("""aggregate(x, cast(array() as array<struct<l:bigint,r:bigint>>), (done, p) ->
        if(size(done) > 0 and p.l <= element_at(done, -1).r, concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).l as l, greatest(element_at(done, -1).r, p.r) as r))), concat(done, array(p))))""")
    return own.select(*keys, id_, F.coalesce("gt", F.lit("UNPHASED")).alias("gt"), joined.alias("exons"))


def alleles_of_ways(ways: DataFrame, parts: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, id, alleles) of the ways that go through parts of one of the two alleles: array<struct<l, r, ale>>, by place."""
    steps = ways.select(*keys, id_, F.explode("way").alias("pid")).join(parts.where(F.col("gt").isin(*ALLELES)).select(*keys, "pid", "l", "r", "ale"), [*keys, "pid"])
    return steps.groupBy(*keys, id_).agg(F.array_sort(F.collect_set(F.struct("l", "r", "ale"))).alias("alleles"))


def strand_votes(reads: DataFrame, keys: list[str], xs: str) -> DataFrame:
    """(keys, strand): the sign that most reads have, a dot where both have as many."""
    votes = reads.groupBy(*keys).agg(F.count_if(F.col(xs) == "+").alias("p"), F.count_if(F.col(xs) == "-").alias("q"))
    return votes.select(*keys, F.when(F.col("p") > F.col("q"), "+").when(F.col("p") < F.col("q"), "-").otherwise(".").alias("strand"))


def surviving_edges(vertices: DataFrame, edges: DataFrame, keys: list[str], least: float = LEAST_SURVIVING, least_heaviest: float = LEAST_HEAVIEST, in_task: int | None = MOST_ROWS) -> DataFrame:
    """The edges (keys, s, t, w) that stay when weak ones go.

    Those of alleles' vertices stay, with their heaviest ways to both ends in the graph without the other allele; those
    of at least the least weight; the heaviest that no allele's vertex ends, of each component without start and end, if
    that is heavy enough (of equals the largest s and t); and what joins all these to both ends by heaviest edges.
    Graphs of at most so many edges (in_task) go in tasks, of which each has whole graphs (None: all are known to be small); larger ones by rounds of jobs.
    """
    edges = edges.select(*keys, "s", "t", "w")
    edges = edges if in_task is None else cut(edges)
    edges, large = by_size(edges, keys, in_task)
    rows = in_tasks(_with_alleles(vertices, edges, keys), keys, edges.schema, lambda table, graph: _surviving(table, graph, least, least_heaviest).select([*keys, "s", "t", "w"]))
    return rows if large is None else rows.union(_surviving_by_rounds(vertices, cut(large), keys, least, least_heaviest))


def _with_alleles(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges with whether their ends are alleles' (null: no vertex), and of which of the two."""
    of = vertices.select(*keys, "v", (F.col("ale") != PLAIN).alias("allelic"), F.when(F.col("gt").isin(*ALLELES), F.col("gt")).alias("gt"))
    ends = edges
    for c in "st":
        ends = ends.join(of.select(*keys, F.col("v").alias(c), F.col("allelic").alias(f"{c}_allelic"), F.col("gt").alias(f"{c}_gt")), [*keys, c], "left")
    return ends


def _last_of(groups: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The place of each group's last item in order."""
    by = np.lexsort((*order[::-1], groups))
    return by[np.append(groups[by][1:] != groups[by][:-1], True)] if len(by) else by


def _on_heaviest_ways(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, chosen: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Which edges are chosen ones or join them to the ends; see with_heaviest_ways()."""
    marked = chosen.copy()
    at = np.flatnonzero(usable)
    for own, other in ((v, u), (u, v)):  # from own back (on) to other
        best = np.full(n, -1)
        last = at[_last_of(own[at], w[at], -other[at])]
        best[own[last]] = last
        best[own[chosen]] = -1
        front = np.unique(other[chosen])
        gone = np.zeros(n, bool)
        while len(front := front[(best[front] >= 0) & ~gone[front]]):
            gone[front] = True
            marked[best[front]] = True
            front = np.unique(other[best[front]])
    return marked


def _components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex that edges join each of n vertices to."""
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        low, new = np.minimum(a, b), least.copy()
        for x in (a, b, u, v):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _surviving(table: pa.Table, graph: np.ndarray, least: float, least_heaviest: float) -> pa.Table:
    """The surviving edges of many graphs, of rows as _with_alleles() gives them."""
    column = lambda c: table[c].to_numpy(zero_copy_only=False)
    s, t, w = column("s"), column("t"), column("w")
    u, v, name, _ = ends_of(graph, s, t)
    ways = lambda chosen, usable: _on_heaviest_ways(u, v, w, len(name), chosen, usable)
    gt = {c: column(f"{c}_gt") for c in "st"}
    chosen = w >= least
    # a copy of the graph for each allele, without the other's vertices
    for own, other in (ALLELES, ALLELES[::-1]):
        usable = (gt["s"] != other) & (gt["t"] != other)
        chosen = chosen | ways(usable & ((gt["s"] == own) | (gt["t"] == own)), usable)
    s_allelic, t_allelic = (np.asarray(table[f"{c}_allelic"].cast(pa.int8()).combine_chunks().fill_null(-1)) for c in "st")
    inner = (s_allelic >= 0) & (t_allelic >= 0)
    component = _components(u[inner], v[inner], len(name))
    plain = np.flatnonzero((s_allelic == 0) & (t_allelic == 0) & (w >= least_heaviest))
    chosen[plain[_last_of(component[u[plain]], w[plain], u[plain], v[plain])]] = True
    return table.filter(pa.array(ways(chosen, np.ones(len(s), bool))))


def _surviving_by_rounds(vertices: DataFrame, edges: DataFrame, keys: list[str], least: float, least_heaviest: float) -> DataFrame:
    """surviving_edges() by rounds of jobs, for graphs of any size."""
    ends = cut(_with_alleles(vertices, edges, keys))
    chosen = ends.where(F.col("w") >= least).select(*keys, "s", "t")
    # a copy of the graph for each allele, without the other's vertices
    copies = ends.withColumn("copy", F.explode(F.array(*map(F.lit, ALLELES))))
    known = lambda c, same: F.coalesce((F.col(c) == F.col("copy")) if same else (F.col(c) != F.col("copy")), F.lit(False))
    copies = cut(copies.where(~known("s_gt", False) & ~known("t_gt", False)))
    own = copies.where(known("s_gt", True) | known("t_gt", True))
    chosen = chosen.union(with_heaviest_ways(own, copies, [*keys, "copy"]).select(*keys, "s", "t"))
    inner = ends.where("s_allelic is not null and t_allelic is not null")
    node = lambda c: F.struct(*keys, F.col(c).alias("v"))
    component = connected_components(inner.select(node("s").alias("src"), node("t").alias("dst"))).select("node.*", "component").withColumnRenamed("v", "s")
    plain = inner.where(~F.col("s_allelic") & ~F.col("t_allelic") & (F.col("w") >= least_heaviest)).join(component, [*keys, "s"])
    heaviest = plain.groupBy("component").agg(F.max(F.struct("w", "s", "t", *keys)).alias("e"))
    chosen = chosen.union(heaviest.select(*(f"e.{k}" for k in keys), "e.s", "e.t"))
    return edges.join(with_heaviest_ways(chosen, edges, keys), [*keys, "s", "t"], "left_semi").select(*keys, "s", "t", "w")
