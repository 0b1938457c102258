"""K-means with bounds against plain Lloyd rounds in exact integers."""

import hashlib
import math
import random
import struct

import numpy as np

from peerlens.llm import hamerly

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, k=8, rounds=10):
    v = {}
    kept = []
    for vec_id, e, _ in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, tuple(math.floor(1024 * x) for x in e)))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), struct.pack("<64i", *r[1])))[:k]
    cents = [list(s[1]) for s in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            own = [x for (_, x), (_, c) in zip(kept, at) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(cents))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(repr((vec_id, c, d, inertia[c], sum(inertia), marks[c])) for (vec_id, _), (d, c) in zip(kept, at))


def got(df):
    out = hamerly.digest(*hamerly.cluster(df))
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in out.collect())


def vectors(n, groups=6, seed=1, spread=0.05):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 0.15) for _ in range(64)] for _ in range(groups)]
    return [(i, [f32(m + rng.gauss(0, spread)) for m in mid[rng.randrange(groups)]], i % 10) for i in range(n)]


def test_equals_plain_rounds(spark):
    for rows in (vectors(300), vectors(120, 1, 2, 0.3)):
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows_and_columns(spark):
    rows = vectors(40, 3)
    one = rows[5][1]
    odd = [(100, None, 1), (101, [], 1), (102, one[:63], 1), (103, [*one, 0.0], 1), (104, [None, *one[1:]], 1), (105, [float("nan"), *one[1:]], 1), (106, [float("inf"), *one[1:]], 1), (None, one, None), (None, one, 2)]
    same = [(200 + i, one, 0) for i in range(60)] + [(7, one, 3)] * 3  # copies of one vector and repeated ids
    df = spark.createDataFrame(rows + odd + same, SCHEMA).selectExpr("*", "1 AS v", "2 AS cluster", "3 AS distance", "4 AS upper")
    assert got(df) == brute(rows + odd + same)


def test_fewer_vectors_than_centroids(spark):
    rows = vectors(3)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == [] and hamerly.digest(*hamerly.cluster(empty)).columns[:3] == ["vec_id", "cluster", "distance"]


def test_bounds_spare_scans_and_change_nothing():
    v = np.array([[math.floor(1024 * x) for x in e] for _, e, _ in vectors(2000)], np.int64)
    cents = v[:8].copy()
    cluster, upper, lower = hamerly._scanned(v, cents)
    met = []
    for _ in range(10):
        after = np.array([v[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else cents[j] for j in range(8)])
        drift = np.sqrt(((after - cents) ** 2).sum(1).astype(float)) * (1 + hamerly.SLACK)
        cents = after
        cluster, upper, lower, n = hamerly.reassigned(v, cluster, upper, lower, cents, drift)
        met.append(n)
        assert (cluster == hamerly._distances(v, cents).argmin(1)).all()
    assert met[-1] < len(v) / 2


def test_large_components_are_exact():
    v = np.array([[2**26 + i * j for j in range(64)] for i in range(5)], np.int64)
    d = hamerly._distances(v, v[:2])
    assert d.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in v[:2]] for x in v]
