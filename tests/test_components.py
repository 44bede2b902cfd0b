"""Components of the whole order-part graph against union-find."""

from braidline.plans import registry

SF = "/root/testdata/sf0.001"


def test_components_of_all_lines(spark):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = find(r.l_orderkey), find(-r.l_partkey)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in registry.QUERIES["q10_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in top}
