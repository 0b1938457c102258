import random
import re

import numpy as np

from peerlens.llm import minhash, shingles
from peerlens.llm.components import components


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    return {r[0]: (len(s), rows[find(k)][0]) for k, (r, s) in enumerate(zip(rows, sets))}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        own = rng.choices(words, k=rng.choice([6, 40, 120, 400]))
        rows.append(" ".join(own))
        for copy in range(8):
            new = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 30)):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append(("  " if copy % 2 else "\n").join(new).upper() if copy == 3 else " ".join(new))
    # a chain whose ends are far apart, and short and empty texts
    chain = rng.choices(words, k=100)
    for k in range(8):
        rows.append(" ".join(chain[k * 6 : k * 6 + 60]))
    rows += ["", None, " \t ", "a b", "A  b", "a b c", "é É", "é é"]
    return [(i * 7 + 3, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows[::-1]], "text string, doc_id long, set_key string, component int")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e  f"), (9, None)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 2, -1, False), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (9, 0, 9, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_without_bias():
    rng = np.random.default_rng(1)
    diff = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 60, 40))
        x, y = minhash.signature(np.concatenate([both, a])), minhash.signature(np.concatenate([both, b]))
        diff.append(np.mean([x[0] == y[0], x[1] == y[1]]) - 0.75)
    assert abs(np.mean(diff)) < 0.02


def test_word_hashes_depend_on_words_only():
    assert shingles.word_hashes("Ab  c\n").tolist() == shingles.word_hashes("\tab c").tolist()
    assert len(shingles.word_hashes("a\x85b \x1cc")) == 2


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(60, 60), (70, 71), (71, 72), (72, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 70: 70, 71: 70, 72: 70}


def test_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def counted(monkeypatch):
    from peerlens.llm import components as c

    made = []
    plain = c.written
    monkeypatch.setattr(c, "written", lambda df, name: made.append(name) or plain(df, name))
    return made


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = counted(monkeypatch)
    n = 100_000
    got = components(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"))
    r = got.selectExpr("count(*) n", "max(component) most").first()
    assert (r.n, r.most) == (n, 0) and made.count("hooks") <= 20


def test_hubs_and_random_graphs(spark, monkeypatch):
    from peerlens.llm import components as c

    monkeypatch.setattr(c, "HOT", 20)
    made = counted(monkeypatch)
    rng = random.Random(3)
    edges = [(500, i) for i in range(400)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(1500)] + [(7, 7), (5000, 4999), (4999, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in plain_components(edges).items() if k != 7 or v != 7 or 7 in {x for e in edges if e[0] != e[1] for x in e}}
    assert "hot-keys" in made and made.count("hooks") <= 20


def test_one_doc_id_with_two_texts_loses_neither(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "text one of this id", "a"), (1, p, "b"), (1, p, "a"), (2, p + " end", "c"), (3, None, "d"), (3, None, "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _of_text string")
    for _ in range(2):
        got = sorted((r.doc_id, r.text or "", r._of_text) for r in minhash.deduplicated(d).collect())
        assert got == [(1, p, "a"), (1, "text one of this id", "a"), (3, "", "d")]


def test_very_long_text_and_hot_band(spark, monkeypatch):
    from peerlens.llm import components as c

    monkeypatch.setattr(c, "HOT", 3)
    monkeypatch.setattr(minhash, "HOT", 3)
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short"), *((10 + i, " ".join(f"q{j}" for j in range(60)) + f" e{i}") for i in range(12))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
