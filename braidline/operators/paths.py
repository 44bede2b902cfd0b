"""Operators on reads, paths and transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Table, cut, is_empty
from .graph import relaxed
from .intervals import prefix


def read_filter(df: DataFrame, flag: str, forbidden: int = 0, required: int = 0, between: dict[str, tuple] | None = None) -> DataFrame:
    """Rows with none of the forbidden flag bits, all required ones, and columns inside closed ranges."""
    df = df.where((F.col(flag).bitwiseAND(F.lit(forbidden)) == 0) & (F.col(flag).bitwiseAND(F.lit(required)) == required))
    for c, (low, high) in (between or {}).items():
        df = df.where(F.col(c).between(low, high))
    return df


def strand_route(df: DataFrame, xs: str, out: str = "strand") -> DataFrame:
    """A row for each strand that a read goes to: its own, or both where it has none."""
    return df.withColumn(out, F.explode(F.when(F.col(xs) == ".", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array(xs))))


def junctions(pairs: DataFrame) -> DataFrame:
    """(a, b, n, strand) of pairs (a, b, plus): the sign that all agree on, else a dot."""
    plus, minus = F.bool_or("plus"), F.bool_or(~F.col("plus"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(plus == minus, ".").when(plus, "+").otherwise("-").alias("strand"))


def allele_votes(df: DataFrame, site: str, voter: str, first: Column, second: Column, share: float = 0.75) -> DataFrame:
    """(site, n1, n2, gt): distinct voters for each allele, and the one with more than the share of them."""
    ballots = df.select(site, voter, first.alias("_a"), second.alias("_b")).distinct().groupBy(site, voter).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    votes = ballots.groupBy(site).agg(F.count_if("_a").alias("n1"), F.count_if("_b").alias("n2"))
    both = (F.col("n1") + F.col("n2")) * share
    return votes.withColumn("gt", F.when(F.col("n1") > both, "ALLELE1").when(F.col("n2") > both, "ALLELE2").otherwise("UNPHASED"))


def filled(df: DataFrame, known: DataFrame, keys: list[str], fill: dict[str, str]) -> DataFrame:
    """df with the known columns of its keys, and the fill where there are none."""
    return df.join(known, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def mates(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs of rows of equal keys, each row in one pair at most, the first with the first."""
    number = lambda df, order: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "_nth"]).drop("_nth")


def chains(df: DataFrame, path: str, place: str, step: Column) -> DataFrame:
    """A row for each path: its steps in order as one string, their number, the ends of its places, and the sum of l_quantity as cov."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), step.alias("f")))), lambda x: x["f"])
    return df.groupBy(path).agg(F.array_join(steps, "-").alias("chain"), F.count("*").alias("n"), F.min(place).cast("long").alias("l"), F.max(place).cast("long").alias("r"), F.sum("l_quantity").alias("cov"))


def kmers(df: DataFrame, path: str, k: int) -> DataFrame:
    """(kmer, n): counts of all windows of k steps."""
    starts = F.slice(path, 1, F.greatest(F.size(path) - k + 1, F.lit(0)))
    return df.select(F.explode(F.transform(starts, lambda _, i: F.array_join(F.slice(path, i + 1, k), "-"))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def routes(df: DataFrame, path: str) -> DataFrame:
    """(v, a, b, support): how many times a path comes from a through v to b."""
    inner = F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0)))
    return df.select(F.explode(F.transform(inner, lambda v, i: F.struct(v.alias("v"), F.col(path)[i].alias("a"), F.col(path)[i + 2].alias("b")))).alias("x")).groupBy("x.v", "x.a", "x.b").agg(F.count("*").alias("support"))


def edges_of_paths(df: DataFrame, path: str, vertex: str, graph: str, source: int, sink: int) -> DataFrame:
    """(g, s, t, w): the edges of all paths through their vertices in ascending order, from source to sink, with how many paths use each. A path's graph is the least that its rows name."""
    line = df.groupBy(path).agg(F.min(graph).alias("g"), F.array_sort(F.collect_set(vertex)).alias("v"))
    way = F.concat(F.array(F.lit(source).cast("long")), "v", F.array(F.lit(sink).cast("long")))
    hops = line.select("g", way.alias("v")).select("g", F.explode(F.transform(F.slice("v", 1, F.size("v") - 1), lambda s, i: F.struct(s.alias("s"), F.col("v")[i + 1].alias("t")))).alias("e"))
    return hops.groupBy("g", "e.s", "e.t").agg(F.count("*").alias("w"))


def wholly_inside(df: DataFrame, inside: DataFrame, path: str, vertex: str) -> DataFrame:
    """(path, n) of the paths all of whose vertices are inside."""
    return df.join(inside.distinct().withColumn("_in", F.lit(1)), vertex, "left").groupBy(path).agg(F.count("*").alias("n"), F.count("_in").alias("_in")).where("n = _in").drop("_in")


def histogram_profile(df: DataFrame, x: str, width: int = 1024) -> DataFrame:
    """Median, 0.5 and 99.8 percent points, and the mean up to 99.9 percent, by the cumulative histogram of the distinct values, in bins of so many."""
    h = df.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n")).select(F.lit(0).alias("_all"), F.floor(F.col("x") / width).alias("_bin"), "x", "n")
    h = prefix(h, ["_all"], "_bin", ["x"], F.sum, F.col("n"), "upto", lambda a, b: a + b, inclusive=True)
    total = h.agg(F.sum("n").alias("total"))
    h = h.join(F.broadcast(total))  # one row
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("x")))
    trim = F.col("upto") - F.col("n") < 0.999 * F.col("total")
    return h.agg(at(0.5).alias("median"), at(0.005).alias("low"), at(0.998).alias("high"), F.round(F.sum(F.when(trim, F.col("x") * F.col("n"))) / F.sum(F.when(trim, F.col("n"))), 6).alias("mean"))


def balanced_sample(df: DataFrame, group: str, place: str, most: int, salts: int = 64) -> DataFrame:
    """The first rows of each group, as many of each as the smallest has, at most so many.

    The first rows of a group are among the first of each of its salted parts, so its last sort has at most salts times
    most rows, however many the group has.
    """
    least = df.groupBy(group).count().agg(F.least(F.min("count"), F.lit(most)).alias("_most"))
    number = lambda rows, *by: rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(place))).where(F.col("_nth") <= most)
    first = number(df.withColumn("_salt", F.pmod(F.xxhash64(place), F.lit(salts))), group, "_salt").drop("_nth", "_salt")
    return number(first, group).join(F.broadcast(least)).where("_nth <= _most").drop("_nth", "_most")  # one row


def clusters(df: DataFrame, keys: list[str], value: str, tie: list[str], gap: float, width: float) -> DataFrame:
    """Adds c, the number of the cluster in its keys: a new one begins where the value exceeds the one before by more than gap. Bins of that width divide the keys."""
    order = [value, *tie]
    df = prefix(df.withColumn("_bin", F.floor(F.col(value) / width)), keys, "_bin", order, F.max, F.col(value), "_before", F.greatest)
    new = (F.col("_before").isNull() | (F.col(value) - F.col("_before") > gap)).cast("int")
    return prefix(df, keys, "_bin", order, F.sum, new, "c", lambda a, b: a + b, inclusive=True).drop("_bin", "_before")


def merged(df: DataFrame, keys: list[str], id_: str, cov: str) -> DataFrame:
    """Transcripts (id, l, r, cov) of equal keys as one: their number, coverage by each mode, and outer bounds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(cov).alias("cov_add"), F.max(cov).alias("cov_max"), F.min(cov).alias("cov_min"), F.min_by(cov, id_).alias("cov_first"), F.min("l").alias("l"), F.max("r").alias("r"))


def specific(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two alleles with gt: that allele, or NONSPECIFIC where the other has the keys too."""
    out = []
    for mine, other, name in ((a, b, "ALLELE1"), (b, a, "ALLELE2")):
        shared = other.select(*keys).distinct().withColumn("_shared", F.lit(True))
        out.append(mine.join(shared, keys, "left").withColumn("gt", F.when(F.col("_shared"), "NONSPECIFIC").otherwise(name)).drop("_shared").select(*mine.columns, "gt"))
    return out[0].union(out[1])


def length_coverage_filter(df: DataFrame, length: str, exons: str, cov: str, base: int = 150, per_exon: int = 50, single: float = 20, multi: float = 1.5) -> DataFrame:
    """Transcripts of at least base + per_exon a exon in length, covered enough for one exon or for more."""
    return df.where((F.col(length) >= base + per_exon * F.col(exons)) & (F.col(cov) >= F.when(F.col(exons) == 1, single).otherwise(multi)))


def phase_split(df: DataFrame, n1: str, n2: str, weight: str, epsilon: float = 0.01) -> DataFrame:
    """Adds w1 and w2: the weight divided by the two counts, each raised by epsilon; -1 where both are zero."""
    both = F.col(n1) + F.col(n2)
    share = lambda n: F.when(both == 0, -1.0).otherwise(F.col(weight) * ((F.col(n) + epsilon) / (both + 2 * epsilon)))
    return df.withColumn("w1", share(n1)).withColumn("w2", share(n2))


def set_difference_counts(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """By group: keys in both (tp), in a alone (fn), in b alone (fp)."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy(*by).agg(F.count_if(shared).alias("tp"), F.count_if(F.col("_b").isNull()).alias("fn"), F.count_if(F.col("_a").isNull()).alias("fp"))


def _beside(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ws and wt, the heaviest edge at the start and at the end."""
    at = lambda c, n: edges.groupBy(*keys, c).agg(F.max("w").alias(n))
    return edges.join(at("s", "ws"), [*keys, "s"]).join(at("t", "wt"), [*keys, "t"])


def without_small_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges but those both of whose ends have one of at least 2 w * w + 18."""
    floor = 2 * F.col("w") * F.col("w") + 18
    return _beside(edges, keys).where(~((F.col("ws") >= floor) & (F.col("wt") >= floor))).select(*edges.columns)


def negligible_edges(edges: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Edges of at most the ratio of the heaviest beside them."""
    return _beside(edges, keys).where(F.col("w") <= ratio * F.greatest("ws", "wt")).select(*edges.columns)


def _through(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, a, b): weight into and out of each inner vertex."""
    into = edges.groupBy(*keys, F.col("t").alias("v")).agg(F.sum("w").alias("a"))
    return into.join(edges.groupBy(*keys, F.col("s").alias("v")).agg(F.sum("w").alias("b")), [*keys, "v"])


def balanced_in_weights(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds balanced: weights into inner vertices times the root of out over in, so that both sides meet at their geometric mean."""
    ratio = _through(edges, keys).select(*keys, F.col("v").alias("t"), F.sqrt(F.col("b").cast("double") / F.col("a").cast("double")).alias("_r"))
    return edges.join(ratio, [*keys, "t"], "left").withColumn("balanced", F.col("w") * F.coalesce("_r", F.lit(1.0))).drop("_r")


def boundary_edges(edges: DataFrame, keys: list[str], source: int, sink: int, factor: float) -> DataFrame:
    """(keys, v, via, w): inner vertices whose weights in and out differ by the factor, the end that makes up for it, and the difference."""
    a, b = F.col("a"), F.col("b")
    return _through(edges, keys).where(F.greatest(a, b) >= factor * F.least(a, b)).select(*keys, "v", F.when(a > b, sink).otherwise(source).cast("long").alias("via"), F.abs(a - b).alias("w"))


def rpkm(df: DataFrame, key: str, coverage: Column, length: Column) -> DataFrame:
    """(key, rpkm): coverage in thousand millions of the total length."""
    total = df.agg(F.sum(length).alias("_total"))
    return df.groupBy(key).agg(F.sum(coverage).alias("_c")).join(F.broadcast(total)).select(key, (F.col("_c") * 1e9 / F.col("_total")).alias("rpkm"))  # one row


def _widest(edges: dict[int, dict[int, float]], order: list[int], source: int, sink: int) -> tuple[float, list[int]]:
    """The widest way from source to sink of a DAG, of equals that through the least vertices, in one pass in topological order."""
    best: dict[int, tuple[float, int]] = {source: (float("inf"), source)}
    for s in order:
        for t, w in sorted(edges.get(s, {}).items()) if s in best else ():
            width = min(best[s][0], w)
            if width > best.get(t, (0.0, s))[0]:
                best[t] = width, s
    if sink not in best:
        return 0.0, []
    way = [sink]
    while way[-1] != source:
        way.append(best[way[-1]][1])
    return best[sink][0], way[::-1]


def decomposed(edges: DataFrame, keys: list[str], source: int, sink: int, least: float = 1.5, vertices: int = 1000) -> DataFrame:
    """(keys, nth, w, path): each graph's widest way from source to sink, taken out, and so on while it is wider than least; of equal ways that through the least vertices, from the sink backwards.

    Vertices ascend along edges. A graph of up to so many vertices is one group; larger ones go by rounds over the whole
    table, see decomposed_by_rounds(), with the same results.
    """
    edges = cut(edges.select(*keys, "s", "t", F.col("w").cast("double").alias("w")))
    large = cut(edges.select(*keys, F.explode(F.array("s", "t")).alias("v")).distinct().groupBy(*keys).count().where(F.col("count") > vertices).select(*keys))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields if f.name in keys), "nth int, w double, path string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted({*pdf["s"], *pdf["t"]})
        rest: dict[int, dict[int, float]] = {}
        for s, t, w in zip(pdf["s"].tolist(), pdf["t"].tolist(), pdf["w"].tolist(), strict=True):
            rest.setdefault(s, {})[t] = w
        out = []
        while (found := _widest(rest, order, source, sink))[0] > least:
            w, way = found
            out.append((*pdf[keys].iloc[0], len(out) + 1, w, ",".join(map(str, way))))
            for s, t in zip(way, way[1:], strict=False):
                rest[s][t] -= w
                if rest[s][t] <= 0:
                    del rest[s][t]
        return pd.DataFrame(out, columns=[*keys, "nth", "w", "path"])

    if is_empty(large):
        return edges.groupBy(*keys).applyInPandas(run, schema)
    small = edges.join(large, keys, "left_anti").groupBy(*keys).applyInPandas(run, schema)
    return small.union(decomposed_by_rounds(edges.join(large, keys, "left_semi"), keys, source, sink, least))


def decomposed_by_rounds(edges: DataFrame, keys: list[str], source: int, sink: int, least: float) -> DataFrame:
    """decomposed() without a group a graph: each round finds the widest way of every graph by relaxation of its edges, and takes it out."""
    edges, nth, found = cut(edges.select(*keys, "s", "t", "w")), 0, Table(edges.sparkSession)
    found.add(edges.limit(0).select(*keys, F.lit(0).alias("nth"), "w", F.lit("").alias("path")))
    while True:
        width = relaxed(edges, source, keys, F.lit(float("inf")), F.least, F.max, "b")
        ways = width.where((F.col("v") == sink) & (F.col("b") > least)).select(*keys, F.col("b").alias("taken"), F.array(F.lit(sink).cast("long")).alias("way"))
        ways = cut(ways)
        if is_empty(ways):
            return found.read()
        # the least vertex by which a vertex has its width
        at = lambda end, name: width.select(*keys, F.col("v").alias(end), F.col("b").alias(name))
        through = edges.join(at("s", "b_s"), [*keys, "s"]).join(at("t", "b_t"), [*keys, "t"]).where(F.least("b_s", "w") == F.col("b_t"))
        before = cut(through.groupBy(*keys, F.col("t").alias("head")).agg(F.min("s").alias("before")))
        while not is_empty(ways.where(F.col("way")[0] != source)):
            ways = ways.withColumn("head", F.col("way")[0]).join(before, [*keys, "head"], "left")
            ways = cut(ways.select(*keys, "taken", F.when(F.col("head") == source, F.col("way")).otherwise(F.concat(F.array("before"), "way")).alias("way")))
        nth += 1
        found.add(ways.select(*keys, F.lit(nth).alias("nth"), F.col("taken").alias("w"), F.array_join("way", ",").alias("path")))
        hops = F.transform(F.slice("way", 1, F.size("way") - 1), lambda s, i: F.struct(s.alias("s"), F.col("way")[i + 1].alias("t")))
        used = ways.select(*keys, "taken", F.explode(hops).alias("e")).select(*keys, "taken", "e.s", "e.t")
        left = edges.join(used, [*keys, "s", "t"], "left").withColumn("w", F.col("w") - F.coalesce("taken", F.lit(0.0)))
        # graphs that had no way any more are done
        edges = cut(left.join(ways.select(*keys), keys, "left_semi").where("w > 0").select(*keys, "s", "t", "w"))


def joined_mates(df: DataFrame, first: str, second: str, out: str, trim_first: int = 0, trim_second: int = 0) -> DataFrame:
    """df with out: the way that two ways are parts of, null where there is none.

    The first way without its last trim_first vertices, the second without its first trim_second: the first has to end at
    a vertex of the second, and both have to be the same from there back to where one of them begins. Vertices ascend along a way,
    so that place is unique, and the check reads each way once. Ways without vertices left have no way in common.
    """
    a, b = F.col("_a"), F.col("_b")
    rows = df.withColumns({"_a": F.slice(first, F.lit(1), F.greatest(F.size(first) - trim_first, F.lit(0))), "_b": F.slice(second, F.lit(trim_second + 1), F.greatest(F.size(second) - trim_second, F.lit(0)))})
    rows = rows.withColumn("_at", F.coalesce(F.array_position("_b", F.try_element_at(a, F.lit(-1))), F.lit(0)).cast("int"))
    n = F.least(F.col("_at"), F.size(a))
    same = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, F.greatest(F.col("_at") - n + 1, F.lit(1)), n)
    rest = F.slice(b, F.col("_at") + 1, F.greatest(F.size(b) - F.col("_at"), F.lit(0)))
    return rows.withColumn(out, F.when((F.col("_at") > 0) & same, F.concat(a, rest))).drop("_a", "_b", "_at")
