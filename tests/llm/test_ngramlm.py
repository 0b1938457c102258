import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np

from peerlens.llm import ngramlm as m


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang = rng.choice(["ing the of stone", "ung der und stein"]).split()
        rows.append((i, " ".join((rng.choice(lang) if rng.random() < 0.6 else f"{rng.choice('abcdef')}{rng.randrange(300)}{lang[0]}") for _ in range(rng.randrange(0, 60)))))
    rows += [(900, None), (901, ""), (902, "ONE one\tOne"), (902, "ONE one\tOne"), (None, "null id words")]
    return rows


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), "\n"]


def test_base_and_known_equal_brute_force(spark):
    rows = corpus()
    got = m.score(spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, score int")).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (i if i is not None else -1, held[i], len(words(t)), sum(w in counts for w in words(t)), round(sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t)), 6)) for i, t in rows
    )
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_equals_brute_force(spark):
    """The whole model in plain Python: counts in dictionaries, EM token by token on rounded estimates."""
    rows = corpus() + [(950, "stone the ing " * 4000)]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    folds = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in rows]

    def grams(t):
        w = ["\n", "\n", *words(t)]
        return [(w[i - 2 : i + 1]) for i in range(2, len(w))]

    def model(keep):
        n = Counter()
        for (_, t), f in zip(rows, folds):
            if keep(f):
                for u, v, w in grams(t):
                    n.update([(w,), (v, w), (u, v, w)])
        total, distinct = sum(k for g, k in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)

        def parts(place, u, v, w):
            first, second = place == 0, place == 1
            uv = n[("\n",)] if first else n[(u, v)]
            nv = n[(v,)]
            context = (1 if uv else 0, (uv or nv).bit_length())
            p = [n[(u, v, w)] / uv if uv else 0.0, n[(v, w)] / nv if nv else 0.0, (n[(w,)] + 1) / (total + distinct + 1)]
            return context, p

        return parts

    parts = model(lambda f: f not in (m.DELETED, m.HELD_OUT))
    seen = [parts(k, *g) for (_, t), f in zip(rows, folds) if f == m.DELETED for k, g in enumerate(grams(t))]
    rounded = [(c, [0.0 if x == 0 else 10 ** -(min(max(np.rint(-3 * log10(x)), 0), m.LEVELS - 2) / 3) for x in p]) for c, p in seen]
    may = {c: [float(c[0] == 1), float(c != (0, 0)), 1.0] for c in {c for c, _ in rounded}}
    weights = {c: [x / sum(may[c]) for x in may[c]] for c in may}
    for _ in range(40):
        gained = {c: [1e-3 * x for x in may[c]] for c in may}
        for c, p in rounded:
            part = [g * x for g, x in zip(weights[c], p)]
            for k in range(3):
                gained[c][k] += part[k] / sum(part)
        weights = {c: [x / sum(g) for x in g] for c, g in gained.items()}
    parts = model(lambda f: f != m.HELD_OUT)
    want = []
    for i, t in rows:
        total = 0.0
        for k, g in enumerate(grams(t)):
            c, p = parts(k, *g)
            even = [float(c[0] == 1), float(c != (0, 0)), 1.0]
            total += log10(sum(a * x for a, x in zip(weights.get(c, [x / sum(even) for x in even]), p)))
        want.append((-1 if i is None else i, round(total, 4)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 4)) for r in got) == sorted(want)


def test_nothing(spark):
    assert m.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_ngrams_of_the_corpus_are_counted(spark):
    # only word n-grams tell which follows which
    rng = random.Random(5)
    pairs = [(f"a{i}zz", f"b{rng.randrange(10**6)}zz") for i in range(300)]
    rows = [(i, " ".join(x for _ in range(20) for x in rng.choice(pairs))) for i in range(400)]
    swapped = " ".join(x for k in range(20) for x in (pairs[k][0], pairs[k + 40][1]))
    straight = " ".join(x for k in range(20) for x in pairs[k])
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], straight), (held[1], swapped)]
    got = {r.doc_id: r for r in m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.held_out and b.held_out and a.n_tokens == b.n_tokens == 41
    assert a.score > b.score + 15


def test_counts_of_ngrams_equal_brute_force(spark):
    rows = corpus()
    blocks = m.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"), 3000)
    assert blocks.count() > 3
    counts = [Counter(), Counter()]

    def grams(t):
        w = ["\n", "\n", *words(t)]
        for i in range(2, len(w)):
            yield from (tuple(w[i - k : i + 1]) for k in (0, 1, 2))

    for i, t in rows:
        f = -1 if i is None else zlib.crc32(str(i).encode()) % 7
        if f != m.HELD_OUT:
            counts[f == m.DELETED].update(grams(t))
    counted = m.gram_counts(blocks, 9, 50)
    sums = counted.where(f"block = {m.TOTALS}").first().found
    for column, want in (("n_all", counts[0] + counts[1]), ("n_kept", counts[0])):
        ones = [k for g, k in want.items() if len(g) == 1]
        assert [sum(int(m.unpack(f[column], 2)[k]) for f in sums) for k in (0, 1)] == [sum(ones), len(ones)]
    for r in blocks.join(counted, "block").collect():
        g = m.Grams(r.texts, m.Words(), 50)
        found = [f.asDict() for f in r.found]
        for column, want in [("n_all", counts[0] + counts[1])] + [("n_kept", counts[0])] * r.deleted:
            one, two, three, v, uv = g.spread(m._found(found, column))
            at = 0
            for t in r.texts:
                w = ["\n", "\n", *words(t)]
                for i in range(2, len(w)):
                    assert [one[at], two[at], three[at]] == [want[tuple(w[i - j : i + 1])] for j in (0, 1, 2)]
                    assert v[at] == want[(w[i - 1],)] and uv[at] == (want[("\n",)] if i == 2 else want[(w[i - 2], w[i - 1])])
                    at += 1
