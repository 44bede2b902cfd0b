"""Splice graphs rewritten by all rules until none applies to any, all graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Table, cut, is_empty
from . import rules
from .graph import cut_counting, prune_dead_ends
from .intask import MOST_ROWS, by_size

#: Where the edges to a graph's end lead while it is rewritten: after all vertices.
_END = 1 << 62


def revised(vertices: DataFrame, edges: DataFrame, keys: list[str], least_length: int = 20, most_intron: float = 2.0, square: float = 10, more: float = 10, dwarfed: tuple[float, float] = (2, 18), in_task: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) after the rules: vertices (see rules) that one of them empties are so, edges are (keys, s, t, w).

    A graph's end is the number after its largest vertex. Edges on no way from start to end go first, and whenever edges
    went; then all but surviving edges. From there on the first rule that applies to a graph is applied and the graph
    begins anew: inner boundaries, small exons and intron contamination empty vertices, small junctions go, vertices are
    joined to the start, then to the end, a weak junction is divided (of several that with the least ends), and all
    but surviving edges go.

    The edges are versions: a round makes the next one only of graphs to which a rule applied, each by its own first
    rule; the others wait, and meet the dearer rule of surviving edges together. Whether a vertex is empty matters to no
    rule that changes edges, so what empties vertices is looked up once for each version, beside these rules, and gathered.
    A graph without edges left, and one without any, keeps its vertices. Sizes of graphs are looked up once: if all have at
    most so many edges (in_task), dead ends and surviving edges are a matter of tasks alone, in all rounds; the weak
    junctions that are divided on the way make at most two edges more for each edge.
    """
    ends = cut(vertices.groupBy(*keys).agg((F.max("v") + 1).alias("_end")))
    inner = F.when(F.col("t") == F.col("_end"), F.lit(_END)).otherwise(F.col("t"))
    edges = cut(edges.join(ends, keys).select(*keys, "s", inner.alias("t"), F.col("w").cast("double").alias("w")))
    most = None if by_size(edges, keys, in_task)[1] is None else in_task
    limits = {"least_length": least_length, "most_intron": most_intron, "square": square, "more": more, "dwarfed": dwarfed}
    emptied, done = Table(vertices.sparkSession), Table(vertices.sparkSession)
    active = _refined(edges, keys, most)
    active = _refined(rules.surviving_edges(vertices, active, keys, in_task=most), keys, most)
    while True:
        settled = _settled(vertices, active, keys, emptied, most, **limits)
        kept = cut(rules.surviving_edges(vertices, settled, keys, in_task=most))
        lost = cut(settled.join(kept, [*keys, "s", "t"], "left_anti").select(*keys).distinct())
        done.add(settled.join(lost, keys, "left_anti"))
        if is_empty(lost):
            break
        active = _refined(kept.join(lost, keys, "left_semi"), keys, most)
    last = done.read().join(ends, keys).select(*keys, "s", F.when(F.col("t") == _END, F.col("_end")).otherwise(F.col("t")).alias("t"), "w")
    gone = emptied.read().distinct().withColumn("_gone", F.lit(True))
    rows = vertices.join(gone, [*keys, "v"], "left").withColumn("empty", F.col("empty") | F.coalesce("_gone", F.lit(False)))
    return rows.select(*vertices.columns), last


def _refined(edges: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    return prune_dead_ends(edges.select(*keys, "s", "t", "w"), 0, _END, keys, most)


def _of(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The vertices of the graphs that have edges."""
    return cut(vertices.join(edges.select(*keys).distinct(), keys, "left_semi"))


def _settled(vertices: DataFrame, active: DataFrame, keys: list[str], emptied: Table, in_task: int | None, least_length: int, most_intron: float, square: float, more: float, dwarfed: tuple[float, float]) -> DataFrame:
    """The edges to which none of the rules but that of surviving edges applies any more; adds to emptied what vertices went empty on the way."""
    settled = Table(vertices.sparkSession)
    while True:
        own = vertices = _of(vertices, active, keys)
        around = cut(rules.surroundings(own, active, keys, empty=True))
        at = (own, active, keys)
        emptied.add(rules.inner_boundaries(*at, around=around).union(rules.small_exons(*at, least_length, around)).union(rules.contaminated_introns(*at, most_intron, around)))
        edits, seen = cut_counting(_first_edits(own, active, keys, around, square, more, dwarfed), {"n": F.lit(True)})
        graphs = edits.select(*keys).distinct()
        settled.add(active.join(graphs, keys, "left_anti"))
        if not seen["n"]:
            return settled.read()
        rest = active.join(graphs, keys, "left_semi").join(edits.where("w is null"), [*keys, "s", "t"], "left_anti")
        active = _refined(rest.union(edits.where("w is not null").select(*keys, "s", "t", "w")), keys, in_task)


def _first_edits(vertices: DataFrame, edges: DataFrame, keys: list[str], around: DataFrame, square: float, more: float, dwarfed: tuple[float, float]) -> DataFrame:
    """(keys, s, t, w) of each graph's first rule that applies: edges that go (w null), and new ones."""
    edit = lambda df, rule, s, t, w: df.select(*keys, F.lit(rule).alias("rule"), s.cast("long").alias("s"), t.cast("long").alias("t"), w.cast("double").alias("w"))
    s, t, v, w, start, end, none = F.col("s"), F.col("t"), F.col("v"), F.col("w"), F.lit(0), F.lit(_END), F.lit(None)
    small = edit(rules.small_junctions(vertices, edges, keys, *dwarfed), 1, s, t, none)
    longer = rules.extended_boundaries(vertices, edges, keys, square, more, around)
    weak = rules.weak_junctions(vertices, edges, keys, square, more).groupBy(*keys).agg(F.min(F.struct("s", "t", "to_end", "from_start")).alias("e")).select(*keys, "e.*")
    of_rules = [
        small,
        edit(longer.where("side = 'start'"), 2, start, v, w),
        edit(longer.where("side = 'end'"), 3, v, end, w),
        edit(weak, 4, s, t, none),
        edit(weak.where("to_end is not null"), 4, s, end, F.col("to_end")),
        edit(weak.where("from_start is not null"), 4, start, t, F.col("from_start")),
    ]
    edits = of_rules[0]
    for more_edits in of_rules[1:]:
        edits = edits.union(more_edits)
    first = edits.groupBy(*keys).agg(F.min("rule").alias("rule"))
    return edits.join(first, [*keys, "rule"]).select(*keys, "s", "t", "w")
