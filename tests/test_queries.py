"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from braidline.plans import loci, overlaps, routes, ways  # noqa: F401  add their queries
from braidline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_query_equals_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = con.sql(registry.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda rs, cs: sorted(repr(tuple(r[cs.index(c)] for c in columns)) for r in rs)
    got = rows([tuple(r) for r in ours.collect()], ours.columns)
    assert got and got == rows(theirs.fetchall(), theirs.columns)


def test_decompose_takes_ways_that_fit_the_weights(spark):
    edges = {(r.g, r.s, r.t): r.w for r in registry._edges(spark, SF).collect()}
    used = {}
    last = {}
    for r in sorted(registry.q28_decompose(spark, SF).collect(), key=lambda r: (r.g, r.nth)):
        way = list(map(int, r.path.split(",")))
        assert way[0] == 0 and way[-1] == 10000 and r.w <= last.get(r.g, r.w)
        last[r.g] = r.w
        for s, t in zip(way, way[1:], strict=False):
            used[r.g, s, t] = used.get((r.g, s, t), 0) + r.w
    assert used and all(w <= edges[k] + 1e-6 for k, w in used.items())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
