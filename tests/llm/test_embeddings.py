"""Embedding links against brute force: two lengths of vectors, hot labels, copies, and vectors that link with nothing."""

import numpy as np

from prosewright.llm import embedding_dedup as E


def brute(rows, threshold=0.98):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[k] = np.array(v) / np.linalg.norm(v)
    links, of = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}
    keys = sorted(ok)
    for a in keys:
        for b in keys:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
                links[a] += 1
                links[b] += 1
                if of[a] != of[b]:
                    of = {k: of[a] if c == of[b] else c for k, c in of.items()}
    least = {}
    for k, c in of.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], least[of[k]], rows[k][0] == least[of[k]]) for k in range(len(rows)))


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for dim in (24, 7):
        for _ in range(60):
            x = rng.standard_normal(dim)
            label = ["a", "b"][int(rng.integers(10) == 0)]
            rows.append((x, label))
            for _ in range(int(rng.integers(0, 6))):
                noise = rng.standard_normal(dim)
                noise -= noise @ x / (x @ x) * x
                cosine = rng.uniform(0.97, 0.9999)
                y = cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
                rows.append((y * rng.uniform(0.1, 9), label))
            if rng.integers(4) == 0:
                rows += [(x.copy(), label)] * 2
    rows = [(i, [float(c) for c in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, "a"), (n + 1, [], "a"), (n + 2, [0.0] * 24, "a"), (n + 3, [1.0] * 23 + [None], "a"), (n + 4, [float("nan")] + [1.0] * 23, "a"), (n + 5, rows[0][1], None), (n + 6, [2.0], "a"), (n + 7, [5.0], "a"), (n + 8, [-1.0], "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, cell int, n int")
    got = sorted(tuple(r) for r in E.links(df, target=1.0).collect())
    assert got == brute(rows) and sum(r[1] for r in got) > 150


def test_recall_of_the_index_at_its_target(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32))
    noise = rng.standard_normal(base.shape)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    noise -= (noise * unit).sum(1)[:, None] * unit
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    pair = 0.981 * unit + np.sqrt(1 - 0.981**2) * noise
    rows = [(i, v.tolist(), "hot") for i, v in enumerate(np.concatenate([unit, pair]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = E.links(df).filter("n_links > 0").count()
    assert found >= 0.98 * len(rows)


def test_empty_table(spark):
    assert E.links(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).count() == 0


def test_visits_come_in_the_multi_sequence_order():
    rng = np.random.default_rng(1)
    index = E.Index((rng.standard_normal((9, 4)), rng.standard_normal((9, 4))), 12, 1.0)
    x = rng.standard_normal((40, 8))
    a, b = index.distances(x)
    sums = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    own, cells = index.place(x)
    assert (own == sums.argmin(1)).all() and all(set(c) == set(np.argsort(s)[:12]) for c, s in zip(cells, sums, strict=True))
