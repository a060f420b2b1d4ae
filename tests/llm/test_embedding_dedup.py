import math
from collections import Counter

import numpy as np

from heliograph.llm.embedding_dedup import near_vectors, possible, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, nid long, tile int, weight long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, 9, 9, "d") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, threshold=0.9):
    good = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    vectors = [np.array(np.array(v, np.float32), np.float64) if g else None for (_, v), g in zip(rows, good, strict=True)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold or (a == b).all():
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (v, _) in enumerate(rows):
        low.setdefault(root(i), []).append(v)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return Counter((v, links[i], low[root(i)], v is not None and v == low[root(i)]) for i, (v, _) in enumerate(rows))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(15):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.5])).tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (1002, [0.0] * 16), (1003, None), (1004, []), (1005, [float("nan")] * 16)]
    rows += [(1006, [None, 1.0] * 8), (1007, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (1008, [1.0, 0.0]), (1009, [2.0, -0.0]), (1010, [1e-30] * 16), (1011, [1e30] * 16)]
    assert Counter(tuple(r) for r in near_vectors(frame(spark, rows), tile_rows=40).collect()) == brute(rows)


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(0, base.tolist()), (1, (base * 1e300).tolist()), (2, (base * 1e-300).tolist()), (3, (-base * 1e300).tolist()), (4, [1e300, 1e-300] * 4), (5, [1.0, 0.0] * 4)]
    rows += [(6, [5e-324] + [0.0] * 7), (7, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in near_vectors(df, tile_rows=3).collect()) == [
        (0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False)
    ]


def test_empty_table(spark):
    assert near_vectors(frame(spark, [])).collect() == []


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((300, 24))
    b = np.concatenate([a[:150] + rng.standard_normal((150, 24)) * 0.45, rng.standard_normal((150, 24))])
    a, b = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (a, b))
    p, q = possible(quantised(a), quantised(b), 0.9)
    found, true = set(zip(p.tolist(), q.tolist(), strict=True)), set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9)), strict=True))
    assert true and found >= true and len(found) < 2 * len(true) + 50
