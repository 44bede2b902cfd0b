"""Routes through the vertices of splice graphs: which of a vertex's edges in and out belong together, and how it divides best.

Edges: (keys, s, t, w), one for each s and t; routes: (keys, v, s, t), the edge from s to v followed by the one from v to t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import connected_components

#: The largest total to which weights are scaled before subsets of them are summed up.
MOST_TOTAL = 1000
_PART = "array<struct<out:boolean,o:bigint>>"


def routes_of_ways(ways: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, s, t, n): the vertices of ways (keys, way) with those before and after, and how often."""
    three = F.transform(F.slice("way", 1, F.greatest(F.size("way") - 2, F.lit(0))), lambda s, i: F.struct(F.col("way")[i + 1].alias("v"), s.alias("s"), F.col("way")[i + 2].alias("t")))
    return ways.select(*keys, F.explode(three).alias("x")).groupBy(*keys, "x.v", "x.s", "x.t").agg(F.count("*").alias("n"))


def legs(edges: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, out, o, w, part): each edge in and out of the vertices that have both, by its other end.

    Legs are of one part if routes join them, directly or by others; a part is named by its least leg (out, o), those in
    before those out. A leg without routes is a part by itself.
    """
    ends = edges.select(*keys, "w", F.explode(F.array(F.struct(F.col("t").alias("v"), F.lit(False).alias("out"), F.col("s").alias("o")), F.struct(F.col("s").alias("v"), F.lit(True).alias("out"), F.col("t").alias("o")))).alias("x")).select(*keys, "x.*", "w")
    ends = ends.join(ends.groupBy(*keys, "v").agg(F.count_if("out").alias("_o"), F.count_if(~F.col("out")).alias("_i")).where("_o > 0 and _i > 0").select(*keys, "v"), [*keys, "v"], "left_semi")
    leg = lambda out, o: F.struct(*keys, "v", F.lit(out).alias("out"), F.col(o).alias("o"))
    joined = connected_components(routes.select(leg(False, "s").alias("src"), leg(True, "t").alias("dst")))
    own = F.struct("out", "o")
    return ends.join(joined.select("node.*", F.struct("component.out", "component.o").alias("part")), [*keys, "v", "out", "o"], "left").withColumn("part", F.coalesce("part", own))


def route_classes(of: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, class, degree, n_in, n_out, parts) of the vertices of legs().

    trivial: one edge in or one out; simple: no routes; single: one part; multiple: all edges in, or all out, are of one
    part; hyper: else. The degree is by how much taking the vertex apart makes the graph's paths more.
    """
    one = of.groupBy(*keys, "v", "part").agg(F.count_if(~F.col("out")).alias("i"), F.count_if("out").alias("o"))
    own = one.groupBy(*keys, "v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("parts"), F.count_if(F.col("i") > 0).alias("_in"), F.count_if(F.col("o") > 0).alias("_out"))
    own = own.join(routes.select(*keys, "v", "s", "t").distinct().groupBy(*keys, "v").agg(F.count("*").alias("_n")), [*keys, "v"], "left").fillna(0, ["_n"])
    trivial, all_ = (F.col("n_in") == 1) | (F.col("n_out") == 1), F.col("n_in") + F.col("n_out")
    class_ = F.when(trivial, "trivial").when(F.col("_n") == 0, "simple").when(F.col("parts") == 1, "single").when((F.col("_in") == 1) | (F.col("_out") == 1), "multiple").otherwise("hyper")
    degree = F.when(trivial, all_).when(F.col("_n") == 0, all_ - 1).when((F.col("parts") == 1) | (F.col("_in") == 1) | (F.col("_out") == 1), F.col("_n") - all_ + 2 * F.col("parts")).otherwise(F.col("parts") - 1)
    return own.select(*keys, "v", class_.alias("class"), degree.alias("degree"), "n_in", "n_out", "parts")


def _first_reached(items: str, total: Column) -> Column:
    """For each sum from 0 to less than total: after how many of the items (n, ...) in order it can first be made, -1 if never."""
    start = F.transform(F.sequence(F.lit(0), total.cast("int") - 1), lambda j: F.when(j == 0, 0).otherwise(-1))
    with_place = F.transform(items, lambda x, i: F.struct(x["n"].cast("int").alias("n"), (i + 1).alias("i")))
    return F.aggregate(with_place, start, lambda got, x: F.transform(got, lambda a, j: F.when(a >= 0, a).when((j >= x["n"]) & (F.get(got, j - x["n"]) >= 0), x["i"]).otherwise(-1)))


def _taken(items: str, first: str, sum_: Column) -> Column:
    """The parts of the items that make the sum."""
    back = F.reverse(F.transform(items, lambda x, i: F.struct(x["n"].cast("int").alias("n"), (i + 1).alias("i"), x["part"].alias("part"))))
    start = F.struct(sum_.cast("int").alias("left"), F.array().cast(_PART).alias("parts"))
    step = lambda done, x: F.when(F.get(first, done["left"]) == x["i"], F.struct((done["left"] - x["n"]).alias("left"), F.concat(done["parts"], F.array(x["part"])).alias("parts"))).otherwise(done)
    return F.aggregate(back, start, step)["parts"]


def splits(of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, imbalance, ins, outs): how the vertices of legs() divide best in two; ins and outs are the other ends of the edges of one half.

    The lighter side is scaled up to the heavier one. A half is a part with several edges, or parts that together bring
    in as much as others take out: what a part has too much or too little is cut to whole numbers, and of all sums of
    some of the one and of some of the other, scaled to MOST_TOTAL at most, the closest two count (of equals the least).
    The half of least imbalance is taken, of equals the single part. Vertices of which no half leaves an edge on each side have none.
    All of a vertex's parts are one row; they are at most as many as it has edges.
    """
    into = F.when(~F.col("out"), F.col("w"))
    sums = of.groupBy(*keys, "v").agg(F.sum(into).alias("_in"), F.sum(F.when(F.col("out"), F.col("w"))).alias("_out"), F.count(into).alias("_n_in"), F.count_if("out").alias("_n_out")).withColumn("_sum", F.greatest("_in", "_out"))
    scaled = F.when(F.col("out"), -F.col("w") * (F.col("_sum") / F.col("_out"))).otherwise(F.col("w") * (F.col("_sum") / F.col("_in")))
    parts = of.join(sums, [*keys, "v"]).groupBy(*keys, "v", "part", "_sum", "_n_in", "_n_out").agg(F.round(F.sum(scaled), 9).alias("over"), F.count_if(~F.col("out")).alias("i"), F.count_if("out").alias("o"))
    parts = parts.withColumn("less", F.col("over") < 0).withColumn("n", F.floor(F.abs("over")))
    # one row a vertex
    side = lambda less: F.collect_list(F.when(F.col("less") == F.lit(less), F.struct("n", "part")))
    rows = parts.groupBy(*keys, "v", "_sum", "_n_in", "_n_out").agg(
        F.array_sort(F.collect_list(F.struct("part", "over", "i", "o"))).alias("all"), side(False).alias("more"), side(True).alias("less"),
        F.min(F.when((F.col("i") > 0) & (F.col("o") > 0), F.struct(F.round(F.col("n") / F.col("_sum"), 9).alias("e"), "less", "part"))).alias("alone"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = cut(rows.withColumn("_top", F.least(F.greatest(total("more"), total("less")), F.lit(MOST_TOTAL))))
    for c in ("more", "less"):
        rows = rows.withColumn("_share", F.when(total(c) > 0, F.col("_top") / total(c)).otherwise(0.0))
        rows = rows.withColumn(c, F.array_sort(F.transform(c, lambda x: F.struct(F.greatest(F.floor(x["n"] * F.col("_share")), F.lit(1)).alias("n"), x["part"].alias("part")))))
    several = cut(rows.where("size(more) > 1 and size(less) > 1"))
    for c in ("more", "less"):
        several = several.withColumn(f"{c}_first", _first_reached(c, total(c)))
    reached = lambda c, k: F.filter(F.transform(f"{c}_first", lambda a, j: F.when(a > 0, F.struct(j.alias("at"), F.lit(k).alias("k")))), lambda x: x.isNotNull())
    several = several.withColumn("_sums", F.array_sort(F.concat(reached("more", 1), reached("less", 2))))

    def pair(x: Column, i: Column) -> Column:
        after = F.get("_sums", i + 1)
        return F.when(after["k"] != x["k"], F.struct((after["at"] - x["at"]).alias("gap"), i.alias("i"), F.when(x["k"] == 1, x["at"]).otherwise(after["at"]).alias("more"), F.when(x["k"] == 2, x["at"]).otherwise(after["at"]).alias("less")))

    several = several.withColumn("_best", F.array_min(F.transform("_sums", pair)))
    several = cut(several.select(*keys, "v", F.concat(_taken("more", "more_first", F.col("_best.more")), _taken("less", "less_first", F.col("_best.less"))).alias("together")))
    rows = rows.join(several, [*keys, "v"], "left")
    of_these = F.filter("all", lambda x: F.array_contains("together", x["part"]))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda y, x: y + x[f])
    e_together = F.when(F.col("together").isNotNull(), F.round(F.abs(add(of_these, "over")) / F.col("_sum"), 9))
    rows = rows.withColumn("e", e_together).withColumn("single", F.col("alone").isNotNull() & (F.col("e").isNull() | (F.col("alone.e") <= F.col("e"))))
    rows = rows.withColumn("half", F.when(F.col("single"), F.array("alone.part")).otherwise(F.col("together"))).withColumn("e", F.when(F.col("single"), F.col("alone.e")).otherwise(F.col("e")))
    rows = rows.withColumn("_of", F.filter("all", lambda x: F.array_contains("half", x["part"])))
    rows = rows.where((add("_of", "i") > 0) & (add("_of", "o") > 0) & (add("_of", "i") < F.col("_n_in")) & (add("_of", "o") < F.col("_n_out")))
    half = rows.select(*keys, "v", F.col("e").alias("imbalance"), F.explode("half").alias("part"))
    ends = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("o"))))
    return half.join(of, [*keys, "v", "part"]).groupBy(*keys, "v", "imbalance").agg(ends(~F.col("out")).alias("ins"), ends(F.col("out")).alias("outs"))
