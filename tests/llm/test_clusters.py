"""Centroid clustering against plain distances: ties, unfit vectors, repeated ids, very large components."""

import hashlib
import math

import numpy as np

from labelloom.llm import clusters


def brute(rows, dims, k, rounds, scale=256, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-clusters.LIMIT, min(clusters.LIMIT, math.floor(scale * x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    size = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda j: (size(v, centres[j]), j))
    for _ in range(rounds):
        held = [near(v) for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), h in zip(kept, held, strict=True) if h == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, near(v), size(v, centres[near(v)])) for i, v in kept]
    total = sum(d for _, _, d in out)
    return sorted(
        ((i, j, d, sum(e for _, h, e in out if h == j), total, tuple(centres[j])) for i, j, d in out), key=str
    )


def found(frame, **how):
    return sorted(
        (
            (r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"]))
            for r in clusters.centroid_clusters(frame, **how).collect()
        ),
        key=str,
    )


def test_rounds_match_plain_distances(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(400)]  # many equal distances
    rows += [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(400, 500)]
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [None, 1.0, 1.0, 1.0]), (505, [math.inf] * 4),
             (506, [math.nan] * 4), (7, rows[9][1]), (7, rows[7][1]), (7, rows[7][1]), (None, [0.5] * 4), (507, [-0.0] * 4)]
    schema = "vec_id long, embedding array<double>, cluster int, v string, distance long"
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
    for k in (1, 2, 13):
        want = brute(rows, 4, k, 3)
        assert found(frame.repartition(5), dims=4, k=k, rounds=3) == want, k


def test_extreme_and_few_vectors(spark):
    rows = [(1, [1e300, -1e300]), (2, [3e5, 3e5]), (3, [3.0e5, -3e5]), (4, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame, dims=2, k=40, rounds=2) == brute(rows, 2, 40, 2)
    assert found(frame, dims=2, k=2, rounds=2) == brute(rows, 2, 2, 2)
    assert found(frame.limit(0), dims=2) == [] == found(frame, dims=3)


def test_one_id_for_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(5 if n % 3 else n, [float(x) for x in rng.standard_normal(3)]) for n in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    singles = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(frame, dims=3, k=6, rounds=1) == brute(singles, 3, 6, 1)


def test_a_changed_bisector_changes_the_result():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-99, 99, (200, 8)), rng.integers(-99, 99, (5, 8))
    table = clusters.Bisectors(c)
    want = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
    assert (table.nearest(x) == want).all()
    table.thresholds[0, 1:] += 1 << 40  # nothing beats centroid 0 any more
    assert (table.nearest(x) == 0).all()
