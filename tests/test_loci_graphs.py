"""Halves of vertices and alleles' shares on the graphs of the given events, against the plain versions."""

from collections import defaultdict

from test_phases import plain_shares
from test_routes import plain_split

from braidline.operators import phases, routes
from braidline.plans import routes as plans
from braidline.plans.loci import KEYS

SF = "/root/testdata/sf0.001"


def test_graphs_of_events(spark):
    vertices, edges, ways = plans._routed(spark, SF)
    found = routes.routes_of_ways(ways, KEYS)
    halves = {(r.chrom, r.locus, r.v): (r.imbalance, r.ins, r.outs) for r in routes.splits(routes.legs(edges, found, KEYS), KEYS).collect()}
    own_v, own_e, ins, outs, through = defaultdict(list), defaultdict(list), defaultdict(dict), defaultdict(dict), defaultdict(list)
    for r in vertices.collect():
        own_v[r.chrom, r.locus].append((r.v, r.ale, r.gt, r.weight))
    for r in edges.collect():
        own_e[r.chrom, r.locus].append((r.s, r.t, r.w))
        ins[r.chrom, r.locus, r.t][r.s] = outs[r.chrom, r.locus, r.s][r.t] = r.w
    for r in found.collect():
        through[r.chrom, r.locus, r.v].append((r.s, r.t))
    compared = 0
    for k in set(ins) & set(outs):
        if 1 < len(ins[k]) and 1 < len(outs[k]) and len(ins[k]) + len(outs[k]) <= 12:
            want, got = plain_split(ins[k], outs[k], through[k]), halves.get(k)
            assert (want is None) == (got is None) and (want is None or abs(got[0] - want[0]) < 2e-9 and got[1:] == want[1:])
            compared += want is not None
    assert compared > 50

    shares = {(r.chrom, r.locus, r.s, r.t): (r.w1, r.w2) for r in phases.allele_shares(vertices, edges, KEYS)[1].collect()}
    divided = 0
    for g, e in own_e.items():
        want = plain_shares(own_v[g], e)
        divided += want is not None
        for s, t, _ in e:
            assert shares[*g, s, t] == (None, None) if want is None else all(abs(x - y) < 1e-6 for x, y in zip(shares[*g, s, t], want[1][s, t], strict=True))
    assert divided > 10 and len(shares) == sum(map(len, own_e.values()))
