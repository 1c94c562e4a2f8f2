import random

from tandem.llm.components import connected_components


def test_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)] + [(5000, i) for i in range(4900, 5100)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {i: root(i) for i in up if any(a != b and i in (a, b) for a, b in edges)}
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want
    assert len(got) == len(want)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
