"""Relational graph operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..runtime import Table, cut, is_empty
from .intask import MOST_ROWS, by_size, ends_of, in_tasks


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of the undirected edges; the component is its smallest node.

    Alternating large-star and small-star rounds: each round links neighbours to the smallest node that a node sees, so
    long chains shrink geometrically and a hub's edges are only regrouped, never paired. Nodes are compared as values;
    null ends are ignored. A round's edges are written to the shared folder, which ends the lineage.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not is_empty(e):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        done = _same(new, e)
        e = new
        if done:
            break
    found = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges are equal: by the number of rows and two sums of 64-bit hashes, one row each."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    of = lambda df: df.agg(F.count("*"), h(1), h(2)).first()
    return of(a) == of(b)


def prune_dead_ends(edges: DataFrame, source: int, sink: int, keys: list[str], most: int | None = MOST_ROWS) -> DataFrame:
    """The edges (keys, s, t, ...) that lie on a way from source to sink: edges whose start has no way in, or whose end none out, go, round by round, until none does.

    Graphs of at most so many edges go in tasks, of which each has whole graphs (None: all graphs are known to be small); all rounds of larger ones are jobs.
    """
    edges = edges if most is None else cut(edges)
    small, large = by_size(edges, keys, most)

    def live(table: pa.Table, graph: np.ndarray) -> pa.Table:
        s, t = (table[c].to_numpy() for c in "st")
        u, v, names, _ = ends_of(graph, s, t)
        left = np.arange(len(s))
        while True:
            into, out = names == source, names == sink
            into[v[left]] = True
            out[u[left]] = True
            stays = into[u[left]] & out[v[left]]
            if stays.all():
                return table.take(pa.array(left))
            left = left[stays]

    pruned = in_tasks(small.dropna(subset=[*keys, "s", "t"]), keys, edges.schema, live)
    return cut(pruned if large is None else pruned.union(_pruned_by_rounds(large, source, sink, keys)))


def _pruned_by_rounds(edges: DataFrame, source: int, sink: int, keys: list[str]) -> DataFrame:
    edges, before = cut_counting(edges, {"n": F.lit(True)})
    while True:
        live = edges.join(edges.select(*keys, F.col("t").alias("s")).union(edges.select(*keys, F.lit(source).cast("long").alias("s"))).distinct(), [*keys, "s"], "left_semi")
        live = live.join(edges.select(*keys, F.col("s").alias("t")).union(edges.select(*keys, F.lit(sink).cast("long").alias("t"))).distinct(), [*keys, "t"], "left_semi")
        edges, after = cut_counting(live.select(*edges.columns), {"n": F.lit(True)})
        if after == before:
            return edges
        before = after


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, n_in, n_out, w_in, w_out, best): degrees and weights of each vertex, and its heaviest edge's other end, of equals the smallest."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("t").alias("o"), F.lit(0).alias("into")), F.struct(F.col("t").alias("v"), F.col("s").alias("o"), F.lit(1).alias("into")))).alias("x"), "w").select(*keys, "x.*", "w")
    into, out = F.col("into") == 1, F.col("into") == 0
    zero = F.lit(0).cast("long")
    return ends.groupBy(*keys, "v").agg(F.count_if(into).alias("n_in"), F.count_if(out).alias("n_out"), F.coalesce(F.sum(F.when(into, F.col("w"))), zero).alias("w_in"), F.coalesce(F.sum(F.when(out, F.col("w"))), zero).alias("w_out"), F.max_by("o", F.struct("w", -F.col("o"))).alias("best"))


def relaxed(edges: DataFrame, source: int, keys: list[str], start: Column, step: Callable[[Column, Column], Column], best: Callable[[Column], Column], out: str) -> DataFrame:
    """(keys, v, out): the best value over all ways from source in a DAG. A way's value is start, then step(value, w) along its edges.

    Rounds of relaxation: each joins the values that changed with the edges that leave there, and stops when none changes.
    The edges are written once, so that rounds do not make them again.
    """
    edges = cut(edges)
    values = cut(edges.select(*keys).distinct().select(*keys, F.lit(source).cast("long").alias("v"), start.alias(out)).withColumn("_new", F.lit(True)))
    while True:
        new = values.where("_new").drop("_new").join(edges.withColumnRenamed("s", "v"), [*keys, "v"])
        new = new.select(*keys, F.col("t").alias("v"), step(F.col(out), F.col("w")).alias(out), F.lit(None).cast(values.schema[out].dataType).alias("_old"))
        merged = values.select(*keys, "v", out, F.col(out).alias("_old")).union(new).groupBy(*keys, "v").agg(best(F.col(out)).alias(out), F.max("_old").alias("_old"))
        values, seen = cut_counting(merged.select(*keys, "v", out, (~F.col(out).eqNullSafe(F.col("_old"))).alias("_new")), {"changed": F.col("_new")})
        if not seen["changed"]:
            return values.drop("_new")


def path_counts(edges: DataFrame, source: int, keys: list[str]) -> DataFrame:
    """(keys, v, n): the number of ways from source to each vertex of a DAG, level by level; ways of any lengths add up."""
    edges = cut(edges)
    level = edges.select(*keys).distinct().select(*keys, F.lit(source).cast("long").alias("v"), F.lit(1).cast("long").alias("n"))
    total = level = cut(level)
    while True:
        level = cut(level.join(edges.withColumnRenamed("s", "v"), [*keys, "v"]).groupBy(*keys, "t").agg(F.sum("n").alias("n")).withColumnRenamed("t", "v"))
        if is_empty(level):
            return total.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
        total = total.union(level)


def topological_levels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, level) of all vertices of the graphs (keys, s, t): the number of edges of the longest way that ends there.

    Rounds for all graphs at once: vertices without an edge in are of the round's level, and their edges out go. Edges
    that stay while no vertex is free are a cycle, which is an error.
    """
    edges = cut(edges.select(*keys, "s", "t").distinct())
    vertices = edges.select(*keys, F.explode(F.array("s", "t")).alias("v")).distinct().join(edges.groupBy(*keys, F.col("t").alias("v")).agg(F.count("*").alias("n")), [*keys, "v"], "left").fillna(0, ["n"])
    level, none = 0, F.lit(None).cast("long")
    state, seen = cut_counting(vertices.withColumn("level", F.when(F.col("n") == 0, F.lit(0).cast("long"))), {"free": F.col("level") == 0, "waiting": F.col("level").isNull()})
    while seen["free"]:
        gone = edges.join(state.where(F.col("level") == level).select(*keys, F.col("v").alias("s")), [*keys, "s"], "left_semi").groupBy(*keys, F.col("t").alias("v")).agg(F.count("*").alias("gone"))
        left = F.col("n") - F.coalesce("gone", F.lit(0))
        level += 1
        state = state.join(gone, [*keys, "v"], "left").select(*keys, "v", left.alias("n"), F.coalesce("level", F.when(left == 0, F.lit(level).cast("long")).otherwise(none)).alias("level"))
        state, seen = cut_counting(state, {"free": F.col("level") == level, "waiting": F.col("level").isNull()})
    if seen["waiting"]:
        raise ValueError("the graph has a cycle")
    return state.select(*keys, "v", "level")


def cut_counting(df: DataFrame, what: dict[str, Column], to: Table | None = None) -> tuple[DataFrame, dict[str, int]]:
    """cut(df), or df as a part of the table to, and how many rows meet each condition, counted by the job that writes them."""
    seen = Observation()
    df = (to.add if to else cut)(df.observe(seen, *(F.count_if(c).alias(k) for k, c in what.items())))
    return df, seen.get


#: How many ways a vertex keeps, how many of a way's weights count, and what stands for a weight that it has not.
BEST_WAYS, LEAST_WEIGHTS, NO_WEIGHT = 10, 5, 999999


def best_ways(edges: DataFrame, sources: DataFrame, keys: list[str], lengths: DataFrame | None = None, most: int = BEST_WAYS, kept: int = LEAST_WEIGHTS, salts: int = 16) -> DataFrame:
    """(keys, source, v, nth, least, length, way): the best ways from each source (keys, source) to each vertex that it reaches in the DAGs (keys, s, t, w).

    A way is as good as its least weights are (kept of them, ascending; the larger ones first), then as it is short, by
    the sum of its vertices' lengths (keys, v, length; 1 each where none are given), then by its vertices. A vertex keeps
    the best ways of those that its predecessors kept, level by level of the graphs, so each edge is met once; all
    graphs and sources go together. Edges into one vertex are divided by salts before its ways are put in order.
    """
    edges = edges.select(*keys, "s", "t", "w")
    levels = topological_levels(edges, keys)
    size = F.lit(1).cast("long") if lengths is None else F.coalesce("length", F.lit(0)).cast("long")
    steps = edges.join(levels.select(*keys, F.col("v").alias("t"), "level"), [*keys, "t"])
    own = (lambda df, v: df) if lengths is None else (lambda df, v: df.join(lengths.select(*keys, F.col("v").alias(v), "length"), [*keys, v], "left"))
    steps = cut(own(steps, "t").select(*keys, "s", "t", "w", "level", size.alias("size")))
    weight = steps.schema["w"].dataType.simpleString()
    start = own(sources.select(*keys, "source", F.col("source").alias("v")).distinct(), "v")
    nothing = F.array_repeat(F.lit(NO_WEIGHT).cast(weight), kept)
    found = Table(edges.sparkSession)
    found.add(start.select(*keys, "source", "v", F.lit(1).alias("nth"), nothing.alias("least"), size.alias("length"), F.array("v").alias("way")))
    order = [F.col("least").desc(), F.col("length"), F.col("way")]
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "source", "v", *by).orderBy(*order))).where(F.col("nth") <= most)
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        new = found.read().withColumnRenamed("v", "s").join(steps.where(F.col("level") == level), [*keys, "s"])
        new = new.select(*keys, "source", F.col("t").alias("v"), F.slice(F.array_sort(F.concat("least", F.array("w"))), 1, kept).alias("least"), (F.col("length") + F.col("size")).alias("length"), F.concat("way", F.array("t")).alias("way"), F.pmod(F.xxhash64("s"), F.lit(salts)).alias("_salt"))
        found.add(first(first(new, "_salt").drop("_salt", "nth")).select(*keys, "source", "v", "nth", "least", "length", "way"))
    return found.read()


def with_heaviest_ways(chosen: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, t): the chosen edges (keys, s, t) with those that join each of them to where its graph begins and ends.

    From the start of a chosen edge that no chosen edge leads to, the heaviest edge in is taken, and so on back until a
    vertex that a chosen edge leads to, or that has none; forward likewise. Of equal edges that with the least other end
    counts. Each direction goes on by itself. Vertices point to the next one of their way, and pointers are doubled in
    each round, so a way of n edges takes about log2(n) rounds.
    """
    chosen, both = cut(chosen.select(*keys, "s", "t").distinct()), [*keys, "back"]
    # both directions in one table: v is the end from which the way goes on to u
    turned = lambda df, *more: df.select(*keys, F.explode(F.array(F.struct(F.lit(True).alias("back"), F.col("t").alias("v"), F.col("s").alias("u")), F.struct(F.lit(False).alias("back"), F.col("s").alias("v"), F.col("t").alias("u")))).alias("x"), *more).select(*both[:-1], "x.*", *more)
    heaviest = turned(edges.select(*keys, "s", "t", "w"), "w").groupBy(*both, "v").agg(F.max_by("u", F.struct("w", -F.col("u"))).alias("u"))
    ends = turned(chosen)
    open_ = cut(heaviest.join(ends.select(*both, "v"), [*both, "v"], "left_anti"))
    on_way, seen = cut_counting(open_.select(*both, "v").join(ends.select(*both, F.col("u").alias("v")), [*both, "v"], "left_semi"), {"n": F.lit(True)})
    jump, n = open_, seen["n"]
    while n:
        further = on_way.join(jump, [*both, "v"]).select(*both, F.col("u").alias("v")).join(open_, [*both, "v"], "left_semi").select(*both, "v")
        on_way, seen = cut_counting(on_way.union(further).distinct(), {"n": F.lit(True)})
        if seen["n"] == n:
            break
        n = seen["n"]
        jump = cut(jump.join(jump.select(*both, F.col("v").alias("u"), F.col("u").alias("_u")), [*both, "u"]).select(*both, "v", F.col("_u").alias("u")))
    added = open_.join(on_way, [*both, "v"], "left_semi").select(*keys, F.when(F.col("back"), F.col("u")).otherwise(F.col("v")).alias("s"), F.when(F.col("back"), F.col("v")).otherwise(F.col("u")).alias("t"))
    return chosen.union(added).distinct()
