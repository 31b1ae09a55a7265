import random

from curatorium.llm.components import components


def test_random_graphs_and_a_long_chain(spark):
    random.seed(4)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(300)]
    edges += [(5, 5), (None, 3), (7, None)] + edges[:10] + [(2000, 2001 + i) for i in range(200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in list(root)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
