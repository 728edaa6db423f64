import random

from quillmesh.llm.components import components


def test_chain_star_and_random(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(150)]
    edges += [(5, 5), (None, 3), (1, 0), (0, 1)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
