import random

from tesserae.llm.components import components


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(-5, i) for i in range(2000, 2080)]
    loose = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    edges = path + star + loose + loose[:20] + [(7, 7)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    f = Forest(len(nodes))
    for a, b in edges:
        if a != b:
            f.join(at[a], at[b])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(x, nodes[f.find(at[x])]) for x in nodes]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
