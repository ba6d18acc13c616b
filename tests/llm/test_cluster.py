import random

import pytest

from oddsloom.llm import cluster
from oddsloom.llm.cluster import connected_components, packed, summed


@pytest.mark.parametrize("small", [0, 20_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(cluster, "SMALL_GRAPH", small)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 80)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3), (3, None), (0, 1), (1, 0), (-7, 59)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    found = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sums(spark):
    import numpy as np

    rows = [(s, p, packed(np.array([s, p, 1 << p % 40], dtype=np.int64))) for s in range(3) for p in range(50)]
    found = summed(spark.createDataFrame(rows, "slice int, part long, counts binary"), 50, fan_in=7)
    assert {s: v.tolist() for s, v in found.items()} == {s: [50 * s, 1225, sum(1 << p % 40 for p in range(50))] for s in range(3)}
