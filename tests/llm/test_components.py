import random

import pytest

components = pytest.importorskip("chainlens.llm.components")


@pytest.mark.parametrize("nodes,links", [(1, 0), (60, 40), (200, 190), (300, 900)])
def test_components_match_union_find(spark, nodes, links):
    rng = random.Random(nodes)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    edges += [(i, i + 1) for i in range(1000, 1000 + min(links, 25))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    expect = {x: root(x) for u, v in edges if u != v for x in (u, v)}
    found = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(found) == len({r["id"] for r in found})
    assert {r["id"]: r["component"] for r in found} == expect
