"""Connected components: long chains, stars, self loops, repeated edges, extreme ids."""

import random

from prosewright.llm._common import Scratch, components


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(5, k) for k in range(2000, 2300)] + [(7, 7), (-(2**63), 2**63 - 1), (2**63 - 1, 3)]
    edges += [(rng.randrange(-500, 0), rng.randrange(-500, 0)) for _ in range(300)]
    rng.shuffle(edges)
    of = {}
    for a, b in edges:
        of.setdefault(a, a), of.setdefault(b, b)
        old, new = max(of[a], of[b]), min(of[a], of[b])
        if old != new:
            of = {k: new if c == old else c for k, c in of.items()}
    alone = {7} | {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    df = spark.createDataFrame(edges + edges[:50], "a long, b long")
    got = {r["id"]: r["component"] for r in components(Scratch(spark), df).distinct().collect()}
    assert {k: c for k, c in got.items() if k not in alone} == {k: c for k, c in of.items() if k not in alone}
    assert components(Scratch(spark), df.limit(0)).count() == 0
