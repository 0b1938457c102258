import itertools
import random

import numpy as np

from peerlens.llm import toxicity as x


def brute(scores):
    """Maximal segments by definition: every proper part scores less, and no larger segment has that property."""
    n = len(scores)
    t = [0.0, *itertools.accumulate(scores)]

    def good(a, b):
        return t[b] > t[a] and all(t[a] < t[i] < t[b] or i in (a, b) for i in range(a, b + 1)) and all(t[i] > t[a] for i in range(a + 1, b + 1)) and all(t[i] < t[b] for i in range(a, b))

    every = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if good(a, b)]
    return [(a, b) for a, b in every if not any((c, d) != (a, b) and c <= a and b <= d for c, d in every)]


def test_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randrange(1, 12))]
        assert [(a, b) for a, b, _ in x.segments(np.array(s))] == brute(s)


def rows(seed=1, n=900):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 200))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(2 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(["moronic", "hateful", f"scumm{rng.choice('abcdef')}{rng.randrange(50)}"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, 0, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows()
    d = spark.createDataFrame([(t, i, 1.0) for i, t in docs] + [(None, None, 0.0), ("", 5000, 0.0)], "text string, doc_id long, score double")
    got = x.predictions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + 2
    truth = {i: t for i, _, t in labels}
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.95 and sum(a and b for a, b in out) > 10
    assert all(0 <= r.score <= 1 for r in got)
    assert all(not r.predicted for r in got if r.doc_id in (None, 5000))


def test_passages_point_into_the_text(spark):
    docs, labels = rows()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = x.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "word1 " * 50 + "MORONIC hateful moronic" + " word2" * 50
    (r,) = x.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[p.start : p.end] for p in r.passages] == ["MORONIC hateful moronic"]
    kept = x.keep_clean(spark.createDataFrame([(1, text, "a"), (2, None, "b")], "doc_id long, text string, lang string"), model).collect()
    assert [(k.doc_id, k.lang) for k in kept] == [(2, "b")]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in x.predictions(d, none).collect()] == [0]
    one = spark.createDataFrame([(1, 0, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in x.predictions(d, one).collect()] == [0]
    assert x.predictions(d.limit(0), one).count() == 0


def accuracy(spark, docs, labels, truth):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = x.predictions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    clean = sorted(s for s, _, t in held if not t)
    cut = clean[int(0.9 * len(clean))]
    toxic = [(s, p) for s, p, t in held if t]
    return sum(s > cut for s, _ in toxic) / len(toxic), sum(p for _, p in toxic) / len(toxic), sum(p for _, p, t in held if not t) / len(clean)


def test_labels_flipped_both_ways(spark):
    docs, labels = rows(seed=5, n=2500)
    rng = random.Random(6)
    wrong = [(i, q, 1 - t if rng.random() < 0.2 else t) for i, q, t in labels]
    order, caught, lost = accuracy(spark, docs, wrong, {i: t for i, _, t in labels})
    assert order > 0.9 and caught > 0.9 and lost < 0.05


def test_most_toxic_rows_are_labelled_clean(spark):
    docs, labels = rows(seed=7, n=2500)
    rng = random.Random(8)
    wrong = [(i, q, 0 if rng.random() < 0.6 else t) for i, q, t in labels]
    order, caught, lost = accuracy(spark, docs, wrong, {i: t for i, _, t in labels})
    assert order > 0.9 and caught > 0.8 and lost < 0.05


def test_labels_that_no_word_explains_reject_nothing(spark):
    docs, labels = rows(seed=9, n=600)
    rng = random.Random(3)
    made = [(i, q, int(rng.random() < 0.1)) for i, q, _ in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sum(r.predicted for r in x.predictions(d, spark.createDataFrame(made, "doc_id long, quality int, toxic int")).collect()) < 10


def test_scores_equal_a_plain_version(spark):
    """Scores of all rows against the definition: word scores, brute-force segments, E values, evidence and curve."""
    docs, labels = rows(seed=2, n=400)
    docs = [(i, " ".join(t.split()[:14])) for i, t in docs] + [(9000, "moronic " * 3000), (9001, None), (9002, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = x.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in x.score(d, model).collect()}
    for i, text in docs:
        words = (text or "").lower().split()
        scores = [model.word(w) for w in words]
        found = brute(scores) if len(scores) < 20 else [(0, len(scores))] if scores[0] > 0 else []
        total = 0.0
        for a, b in found:
            total += np.log1p(1 / max(model.density * len(words) * np.exp(-model.rate * sum(scores[a:b])), 1e-300))
        want = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.log1p(total), -30, 30)))
        assert abs(got[i] - want) < 1e-6, i


def test_features_equal_a_plain_count(spark):
    docs, labels = rows(seed=4, n=300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows_ = x.training_rows(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = {}
    for r in rows_.collect():
        for f in {""}.union(*(x.features(w) for w in set(r.text.split()))):
            want.setdefault(f, [0] * 8)[r.fold + (0 if r.toxic else 4)] += 1
    assert {r.feature: list(r[1:]) for r in x.count_features(rows_).collect()} == want


def test_extra_columns_come_back_untouched(spark):
    model = x.Model({"bad$": 6.0}, 1.0, 0.1, -3.0, 2.0)
    d = spark.createDataFrame([(1, "good", 7, "w"), (1, "good", 7, "w"), (2, "bad bad bad", 8, "v"), (None, None, None, None)], "doc_id long, text string, score long, passages string")
    kept = x.keep_clean(d, model)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "good", 7, "w")] * 2 + [(None,) * 4], key=str)
