"""Connected components."""

import random

import pytest

from corpusloom.llm import graph


@pytest.mark.parametrize("forest_edges", [1, 500_000])
def test_components(spark, monkeypatch, forest_edges):
    monkeypatch.setattr(graph, "FOREST_EDGES", forest_edges)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (1, 0)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {n: c for n, c in label.items() if n != c}
    assert graph.components(df.limit(0)).count() == 0
