"""Hard negatives against sorting all scores."""

import math
import random
import struct
from collections import Counter

import numpy as np
import pytest

from peerlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows):
    kept = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    anchors = {}
    for r in kept:
        if r[0] is not None and r[0] % 100 == 0:
            mark = (r[1], struct.pack(f"<{len(r[2])}i", *r[2]))
            if r[0] not in anchors or mark < anchors[r[0]][0]:
                anchors[r[0]] = (mark, r)
    out = []
    for _, (_, (a, label, v)) in anchors.items():
        met = sorted(((-sum(x * y for x, y in zip(v, w)), i is None, i if i is not None else 0, b == label) for i, b, w in kept if i != a))
        for p in [m for m in met if m[3]][:5]:
            fits = [m for m in met if not m[3] and 30 * -p[0] <= 100 * -m[0] <= 90 * -p[0]][:10]
            out += [repr((a, None if p[1] else p[2], n, None if m[1] else m[2], -p[0], -m[0])) for n, m in enumerate(fits, 1)]
    return Counter(out)


def got(df, **how):
    return Counter(repr((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in negatives.mine(df, **how).collect())


def vectors(n, seed=1, dim=16, groups=4):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 0.5) for _ in range(dim)] for _ in range(groups)]
    out = []
    for i in range(n):
        g = rng.randrange(groups)
        out.append((i, [f32(m + rng.gauss(0, 0.4)) for m in mid[g]], rng.choice([g, rng.randrange(10)])))
    return out


def test_equals_sorting(spark):
    rows = vectors(700)
    want = brute(rows)
    assert want and got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == want
    assert got(spark.createDataFrame(rows, SCHEMA), block=2) == want  # several blocks of anchors


def test_many_ties(spark):
    rows = vectors(350, 2)
    one, other = rows[3][1], rows[4][1]
    rows = [(i, one if i % 3 == 0 else other if i % 3 == 1 else e, label) for i, e, label in rows]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(230, 3)
    e = rows[0][1]
    odd = [(300, None, 1), (400, e, None), (500, [None, *e[1:]], 1), (600, [float("nan"), *e[1:]], 1), (700, [float("-inf")], 1), (800, [], 2), (900, [0.0] * 16, 2), (1000, [-x for x in e], 2), (None, e, 1), (None, e, 1), (None, None, None), (901, [*e, 2.0], 3)]
    again = [rows[0], rows[0], (100, rows[7][1], 0), rows[11], rows[11]]  # repeated anchors and candidates
    df = spark.createDataFrame(rows + odd + again, SCHEMA).selectExpr("*", "1 AS v", "2 AS norm", "3 AS anchor_id", "4 AS score")
    assert got(df) == brute(rows + odd + again)


def test_no_rows_and_lone_anchor(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == Counter()
    assert got(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)) == Counter()
    assert got(spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 2)], SCHEMA)) == brute([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 2)])


def test_large_scores_are_exact_or_refused():
    a, b = np.array([[2**27, 3]]), np.array([[2**27, 5], [1, -(2**27)]])
    assert negatives._scores(a, b).tolist() == [[2**54 + 15, 2**27 - 3 * 2**27]]
    with pytest.raises(ValueError):
        negatives._scores(np.full((1, 2), 2**31), np.full((1, 2), 2**31))
