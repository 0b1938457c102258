"""Fingerprints, URL filters and decontamination against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from peerlens.llm import decontam, fingerprints, queries, urlfilter
from peerlens.llm import oracle as llm_oracle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def runs(p):
    """Leaves of a paragraph."""
    pieces = re.findall(r"[ \t\x0b\f\r]*[^ \t\x0b\f\r]{1,16}[ \t\x0b\f\r]*|[ \t\x0b\f\r]+", p)
    n = 1 if len(p) <= 64 else 4
    return ["".join(pieces[i : i + n]) for i in range(0, len(pieces), n)]


def root(t):
    return sha("".join(sha("".join(sha("".join(sha(r) for r in runs(p))) for p in s.split("\n"))) for s in t.split("\n\n")))


def marks(t):
    return [sha(r)[:8] for p in t.split("\n") for r in runs(p)]


def texts():
    rng = random.Random(3)
    rows = [(i * 3, "\n".join(" ".join(rng.choices(["aé", "b", "word", "x" * 9], k=rng.randrange(0, 20))) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "one"), (203, "one"), (204, "ü" * 3000), (205, " \tlead\t tabs\x0b" + "字" * 70 + "  "), (206, "".join(f"{i}語" for i in range(900))), (None, "no id")]


def test_fingerprints_equal_brute_force(spark):
    rows = texts()
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(t, i, "c", 5) for i, t in rows[::-1]], "text string, doc_id long, fingerprint string, own int")).collect()
    ordered = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    want = []
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = ((root(x), set(marks(x))) for x in (t, e, nxt))

        def like(x, y):
            n = len(x[1]) + len(y[1])
            return 1.0 if x[0] == y[0] else 2 * len(x[1] & y[1]) / n if n else 0.0

        want.append((i, len(t), sha(e), f"{a[0]}:{''.join(marks(t))}", f"{b[0]}:{''.join(marks(e))}", round(like(a, b), 9), round(like(a, c), 9)))
    made = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(made) == sorted(want)


def test_text_without_spaces_keeps_its_likeness(spark):
    a = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(2000))
    b = a[:1500] + a[:500]
    d = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string")
    (r,) = d.select(fingerprints.likeness(fingerprints.tree(F.col("a")), fingerprints.tree(F.col("b"))).alias("like")).collect()
    assert 0.7 < r.like < 0.9


def test_fingerprints_of_nothing_and_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(empty).count() == 0
    (r,) = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == sha("a b c a") and r.near_next == 1.0


def test_differing_sections(spark):
    df = spark.createDataFrame([("a\n\nb\nc\n\nd", "a\n\nb\nX\n\nd\n\ne")], "x string, y string")
    r = df.select(fingerprints.differing_sections(fingerprints.tree(F.col("x")), fingerprints.tree(F.col("y"))).alias("d")).first()
    assert r.d == [1, 3]


URLS = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/8", "http://com/en/", "http://badcom/en/1", "http://x.net/de/8", "http://example.net/de/8?q", "http://m.example.net/de/9#t", "ftp://a.org/es/", "http://a.org", "no scheme/en/", "", None, "http://a.com/en", "http://a.com?/en/", "x://y.com/en/z://q", "http://.com/en/1", "http://a..com/en/1"]


def judged(url):
    ok = url is not None and "://" in url
    rest = url.split("://", 1)[1] if ok else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if ok and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_RULES, 0])
def test_url_filters(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame([(u, i, "h", "x") for i, u in rows], "url string, page_id long, host string, rule string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *judged(u)) for i, u in rows), key=str)


def test_url_filters_follow_the_contract(spark):
    urls = {"https://a.com/en/1": ("com/en/", "block"), "https://www.example.com/en/71": ("example.com/en/7", "allow"), "https://b.net/de/8": ("net/de/", "allow"), "https://example.net/de/9": ("net/de/", "allow"), "https://www.example.net/de/81": ("example.net/de/8", "block"), "https://c.org/es/": ("org/es/", "block"), "https://c.org/": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(urls.values()))


def test_url_filters_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = urlfilter.rule_table(spark, [])
    assert [(r.rule, r.verdict) for r in urlfilter.judge(pages, none, otherwise="block").collect()] == [(None, "block")]
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def windows(words):
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("max_words, piece", [(10**6, 5000), (12, 5000), (30, 4)])
def test_decontamination_equals_brute_force(spark, monkeypatch, max_words, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = random.Random(6)
    words = ["alpha", "Beta", "é", "ça", "x1", "2", "delta"]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([3, 12, 25, 10, 1, 14])] + [(90, None), (91, "!!"), (92, "alpha Beta é"), (93, "ALPHA, beta: é")]
    docs = []
    for i in range(60):
        own = rng.choices(words, k=rng.randrange(0, 80))
        if i % 4 == 0:
            own += rng.choice(items[:6])[1].split(" ")
        docs.append((i, rng.choice([" ", ", ", "\n_"]).join(own)))
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (None, items[1][1])]
    d = spark.createDataFrame([(t, i, "w") for i, t in docs], "text string, doc_id long, items string")
    b = spark.createDataFrame([(t, i, "z") for i, t in items], "text string, item_id long, doc_id string")
    got = decontam.digest(decontam.scan_documents(d, b, max_words=max_words)).collect()
    pats = {i: windows(split(t)) for i, t in items}
    clean = decontam.clean(d, b, max_words)
    assert clean.columns == d.columns
    want = []
    for i, t in docs:
        w = split(t)
        hit, met = set(), set()
        for k, ps in pats.items():
            for p in ps:
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s : s + len(p)]) == p:
                        met.add(str(k))
                        hit.update(range(s, s + len(p)))
        want.append((i, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((i or -1) for i, *_, hit in want if not hit)


def test_one_automaton_is_alive_and_built_once(monkeypatch):
    class Shared:
        def __init__(self, name, block):
            self.value = name, block

    made = []
    plain = decontam.automaton
    monkeypatch.setattr(decontam, "automaton", lambda block: made.append(block) or plain(block))
    a, b = Shared("a", [("1", "x y")]), Shared("b", [("2", "z")])
    for shared in (a, a, b, b, a):
        decontam._loaded(shared)
        assert len(decontam._BUILT) == 1
    assert len(made) == 3


def test_blocks_hold_few_words_and_long_texts_are_scanned(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(50)] + [(99, " ".join(f"l{k}" for k in range(12_000)))]
    b = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontam._blocks(b, 8_000))
    assert len(blocks) >= 2 and all(sum(len(t.split()) for _, t in x) <= 3 * 8_000 for x in blocks)
    long = " ".join(f"x{k}" for k in range(50_000)) + " " + " ".join(f"l{k}" for k in range(4_990, 5_020))
    d = spark.createDataFrame([(1, long), (2, "i3w0 " * 20), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.digest(decontam.scan_documents(d, b, 8_000)).collect()}
    assert got == {1: (50_030, 30), 2: (20, 0), 3: (0, 0)}


def test_names_that_clash_are_refused(spark):
    d = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, runs int")
    with pytest.raises(ValueError):
        decontam.scan_documents(d, d.selectExpr("doc_id as item_id", "text"), extra=("runs",))


def test_decontamination_spans_and_empty_tables(spark):
    text = "Intro: Alpha, BETA; gamma end"
    built = decontam.automaton([("1", "alpha beta gamma")])
    runs, items = decontam.scan(built, decontam.words_of(text))
    assert [text[a:b] for a, b in decontam.spans(text, runs)] == ["Alpha, BETA; gamma"] and items == {0}
    d = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.scan_documents(d, none)).first().contaminated is False
    assert decontam.scan_documents(d.limit(0), none).count() == 0
    assert decontam.clean(d, none).columns == d.columns and decontam.clean(d, none).count() == 1


def test_names():
    assert len(queries.QUERIES) == 13
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(llm_oracle.ORACLES) <= set(queries.QUERIES)
