"""Mixing: targets against a plain water level, copies against a plain running sum."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from peerlens.llm import mixing

DOCS = "doc_id long, text string, source string"


def water(sizes: dict, weights=mixing.WEIGHTS, most=mixing.MOST) -> dict:
    """Targets by repeated resharing, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = Fraction(sum(sizes.values())), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, seed=mixing.SEED):
    by = defaultdict(list)
    for doc_id, text, source in rows:
        n = size_of(text)
        mark = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        bits = n.bit_length() or 1
        by[source].append((bits * 256 + (n >> max(bits - 8, 0)), int(mark[:15], 16), doc_id, n))
    sizes = {s: sum(r[3] for r in rs) for s, rs in by.items()}
    target = water(sizes)
    out = []
    for s, rs in by.items():
        e = int(target[s] * 2**32 / sizes[s]) if sizes[s] else 0
        at = int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:8], 16)
        for _, _, doc_id, n in sorted(rs, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2])):
            out.append((doc_id, n, sizes[s], (at + e) // 2**32 - at // 2**32))
            at += e
    return out, target


def corpus(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "é", "z", None])
        rows.append((i, " ".join("w" for _ in range(int(rng.paretovariate(0.8)) % 700)), source))
    return rows


def test_equals_a_plain_running_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 15)  # many blocks
    rows = [*corpus(), (400, None, "a"), (401, "", "b"), (402, "one  two\n\vthree", "none yet")]
    got = mixing.allocation(spark.createDataFrame(rows, DOCS)).collect()
    want, target = brute(rows)
    assert sorted((r.doc_id, r["size"], r.source_size, r.copies) for r in got) == sorted(want)
    assert all(r.taken == r["size"] * r.copies <= 3 * r["size"] for r in got)
    of = {d: s for d, _, s in rows}
    assert all(abs(r.target - float(target[of[r.doc_id]])) < 1e-6 * max(1, r.target) for r in got)


def test_taken_words_are_near_the_targets(spark):
    rows = corpus(3000)
    got = mixing.allocation(spark.createDataFrame(rows, DOCS)).collect()
    of, taken, target, most = {d: s for d, _, s in rows}, defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        taken[s], target[s], most[s] = taken[s] + r.taken, r.target, max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-3


def test_targets_of_lopsided_sources(spark):
    for sizes in ([1, 1, 1000], [1000, 1, 1], [0, 5, 5, 5], [0, 0], [7], [100, 100, 1, 1, 50, 2]):
        table = spark.createDataFrame([((False, f"s{i}"), n) for i, n in enumerate(sizes)], "key struct<null:boolean,name:string>, source_size long")
        got = {r.key.name: r.target for r in mixing.targets(table).collect()}
        want = water({f"s{i}": n for i, n in enumerate(sizes)})
        assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-9 * max(1, float(want[s])) for s in want)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "x", "s"), (1, "x", "s"), (2, "", "s"), (None, None, None), (3, "long " * 20000, "t")]
    docs = spark.createDataFrame(rows, DOCS)
    first, again = (sorted(map(repr, mixing.allocation(docs).collect())) for _ in range(2))
    assert first == again and len(first) == len(rows)
    assert mixing.allocation(docs.limit(0)).collect() == []


def test_mix_repeats_documents_and_keeps_columns(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 10 == 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS copies", "1 AS _size", "2 AS copy", "'x' AS _Key", "3 AS slices")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r.copies for r in mixing.allocation(docs).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert r.copies == r.doc_id and r._size == 1
    assert dict(got) == {d: c for d, c in n.items() if c}


def test_plan_has_no_python_worker(spark):
    plan = mixing.allocation(spark.createDataFrame([(1, "a b", "s")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
