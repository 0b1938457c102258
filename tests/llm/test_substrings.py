import hashlib
import random

import numpy as np

from peerlens.llm import substrings, suffixes


def brute(rows, texts=False):
    seen: dict[bytes, tuple] = {}
    places = []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            places.append((i, p, b[p : p + 100]))
    for i, p, s in sorted(places, key=lambda x: (x[0], x[1])):
        seen.setdefault(s, (i, p))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] != (i, p):
                gone[p : p + 100] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = kept.decode(errors="ignore") if texts else (len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "élan", "zeta", "eta", "theta", "iota", "kappa"] + [f"w{i}" for i in range(200)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(15, 60))) for _ in range(8)]
    rows = []
    for i in range(70):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [p[a : len(p) - rng.randrange(0, 40)], " ".join(rng.choices(words, k=rng.randrange(0, 30)))]
        rows.append((i * 2, rng.choice([" ", ""]).join(parts)))
    rows += [(501, rows[3][1]), (502, rows[3][1]), (503, "ab" * 200), (504, "a" * 333), (505, "b" + "a" * 150), (506, None), (507, ""), (508, "x" * 99), (509, "\x00\xff" * 120), (510, "Shti " * 100 + "end"), (511, "y" + "Shti " * 60)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, key string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(docs).collect()}
    assert got == brute(rows)


def test_dealt_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 3)
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_one_passage_between_different_words(spark, monkeypatch):
    """Windows of one passage in every document, each time with other neighbours: no block holds the group, none of its windows is lost."""
    monkeypatch.setattr(substrings, "GROUP", 10)
    monkeypatch.setattr(substrings, "HOT", 5)
    p = "the same hundred and thirty bytes of text stand here in each and every document of this small collection, between other words."
    rows = [(i, f"{i * 7919} before {i} {p} {i * 104729} behind {i * 31}") for i in range(80)] + [(1000, p), (1000, p), (None, None)]
    rows = [(i, t) for i, t in rows if i is not None] + [(2000, None)]
    plans = []
    plain = substrings.dealt_windows
    monkeypatch.setattr(substrings, "dealt_windows", lambda c: plans.append(c.count()) or plain(c))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and plans and plans[0] > 80


def test_colliding_hashes_remove_nothing(spark, monkeypatch):
    """Surroundings that all have one hash: the bytes tell, and what isn't equal goes through the suffix arrays."""
    plain = substrings.anchors

    def colliding(data, doc_end, length=substrings.LENGTH):
        h, c, first, n = plain(data, doc_end, length)
        return h, np.zeros_like(c), first, n

    monkeypatch.setattr(substrings, "anchors", colliding)
    wrong = []
    proof = substrings.with_proof
    monkeypatch.setattr(substrings, "with_proof", lambda *a: (lambda df: wrong.append(df.where("not proved").count()) or df)(proof(*a)))
    rows = corpus()
    for maximum in ("10000", "7"):
        old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", maximum)
        try:
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert got == brute(rows)
    assert len(wrong) == 2 and all(wrong)


def test_extra_columns_survive(spark):
    p = " ".join(f"passage{i}" for i in range(30))
    d = spark.createDataFrame([(1, p, 7, 8, [1], "x.y"), (2, "and " + p, 8, 9, None, None)], "doc_id long, text string, _key int, _mark int, Ranges array<int>, `a.b` string")
    got = sorted(substrings.cleaned(d).collect())
    assert substrings.cleaned(d).columns == d.columns
    assert [tuple(r) for r in got] == [(1, p, 7, 8, [1], "x.y"), (2, "and ", 8, 9, None, None)]


def test_very_long_text(spark):
    rng = random.Random(11)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4000)) for _ in range(2)]
    rows = [(1, own[0] + own[1]), (2, own[1] + " tail"), (3, "short")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_long_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 3)
    monkeypatch.setattr(substrings, "GROUP", 2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        p = " ".join(f"passage{i}" for i in range(20))
        rows = corpus() + [(600 + i, f"{'xyz'[i % 3] * (i % 7)} {p}{i % 5}") for i in range(60)]
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows)


def test_nulls_repeats_and_nothing(spark):
    p = " ".join(f"passage{i}" for i in range(30))
    docs = spark.createDataFrame([(None, p), (3, p), (3, p), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed, r.n_bytes) for r in substrings.digest(docs).collect())
    assert got == [(-1, 0, len(p)), (3, len(p), len(p)), (3, len(p), len(p)), (4, 0, 0)]
    assert substrings.digest(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, p), (3, p)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.digest(twice).collect()] == [0, 0]


def test_cleaned_keeps_columns(spark):
    p = " ".join(f"passage{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "own " + p, "en", "s", 0), (2, p + " é more", "fr", "s", 0), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in substrings.cleaned(docs).collect()}
    assert got[1].text == "own " + p and got[2].text == " é more" and got[2].n_chars == 7 and got[3].text is None and got[2].lang == "fr"


def test_suffix_order_equals_sorting():
    rng = random.Random(9)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abcd\x00\xff", k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined[at[1:] - 1] = 0
        wanted = joined > 0
        sa = suffixes.suffix_order(joined, wanted)
        ends = {int(a + k): t[k:] for t, a in zip(texts, at) for k in range(len(t))}
        assert sorted(sa.tolist()) == sorted(ends)
        ordered = [ends[i] for i in sa.tolist()]
        assert ordered == sorted(ordered)
