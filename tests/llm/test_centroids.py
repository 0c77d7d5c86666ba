"""Bit planes: exact distances, clustering against plain whole numbers, ties, repeated rows, huge components."""

import hashlib
import math
import random

import numpy as np

from ultraspan.llm import centroids as C


def whole(v):
    return [C._whole(float(np.float32(x))) for x in v]


def brute(rows, k=8, rounds=10):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centre)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return out, centre


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)


def test_distances_of_planes():
    rng = np.random.default_rng(1)
    for top in (1, 2, 3000, 1 << 26, 1 << 40, 10**41):
        v = np.array([[int(x) for x in rng.integers(-(1 << 50), 1 << 50, 64)] for _ in range(6)], object) * top // (1 << 50)
        planes = C.to_planes(v)
        assert [C.from_planes(p) for p in planes] == v.tolist() and C.component_sums(planes) == v.sum(axis=0).tolist()
        c = [C._as_planes(x) for x in (v[0].tolist(), (v[1] // 7).tolist(), [5] * 64)]
        expected = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in (v[0].tolist(), (v[1] // 7).tolist(), [5] * 64)] for x in v.tolist()]
        assert C.squared_distances(planes, c).tolist() == expected
    assert sum(d << (C.DIGIT * i) for i, d in enumerate(C._digits(-(10**30)))) == -(10**30)


def test_clusters_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 1.0) for _ in range(64)]) for i in range(150)]
    rows += [(i % 9, rows[i % 4][1]) for i in range(40)]  # repeated ids and vectors
    rows += [(None, rows[3][1]), (200, None), (201, [1.0] * 63), (202, [None] + [1.0] * 63), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, [-0.0004] * 64), (206, [1e6] * 64)]
    assigned, centre = C.centroid_clusters(table(spark, rows))
    expected, centre_expected = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(expected, key=key) and centre == centre_expected
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = C.op12_centroids(spark, str(tmp_path)).collect()
    inertia = {j: sum(d for _, c, d in expected if c == j) for j in range(8)}
    assert list(out[0].asDict()) == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for r in out:
        assert (r["cluster_inertia"], r["inertia"]) == (inertia[r["cluster"]], sum(inertia.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centre[r["cluster"]])).encode()).hexdigest()


def test_few_huge_and_no_vectors(spark, tmp_path):
    rows = [(1, [0.5] * 64), (1, [0.25] * 64), (2, [1.0] * 64)]
    assigned, centre = C.centroid_clusters(table(spark, rows))
    assert sorted(tuple(r)[1:] for r in assigned.collect()) == [(0, 0), (1, 0), (2, 0)] and len(centre) == 3
    huge = [(i, [3e38 * (-1) ** i] + [float(i)] * 63) for i in range(20)]
    assigned, centre = C.centroid_clusters(table(spark, huge))
    expected, centre_expected = brute(huge)
    assert centre == centre_expected
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in assigned.collect()} == {i: (c, d if d <= C.LONG_MAX else None) for i, c, d in expected}
    table(spark, [(1, None)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert C.op12_centroids(spark, str(tmp_path)).collect() == []
