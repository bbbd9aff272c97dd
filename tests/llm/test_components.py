import random

import numpy as np

from geotrail.llm.components import connected_components
from geotrail.llm.unionfind import union


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]                # a long path
    edges += [(5000, 5000 + i) for i in range(1, 300)]                # a star
    edges += [(7, 7), (9000, 9000)] + edges[:20]                      # loops and repeats
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {n: c for n, c in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_union_keeps_the_smallest_root():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        a, b = rng.integers(0, n, 40), rng.integers(0, n, 40)
        parent = np.arange(n)
        union(parent, a[:20], b[:20])
        union(parent, a[20:], b[20:])
        want = brute([(int(x), int(y)) for x, y in zip(a, b)])
        assert all(parent[i] == want.get(i, i) for i in range(n))
