"""Bounds of blocks against scoring everything; segments, containment and corrections against plain Python."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.operators import containment, retrieval, scoring, segments, textindex
from peerlens.plans import consult

C = "company_id int, name string, description string, categories array<string>, macros array<string>, country string, founded_year string, headcount string, status string, cause string, cause_inferred boolean, embedding array<float>"
Q = "query_id int, name string, one_liner string, categories array<string>, macros array<string>, model string, country string, founded_year string, team_size string, stage string, cause string, secondary array<string>, embedding array<float>"
WORDS = [f"word{chr(97 + i)}" for i in range(24)]


def companies(rng, n):
    for i in range(n):
        macro = rng.sample(["fin", "food", "ai", "web"], rng.choice([0, 1, 1, 2]))
        yield (
            i, f"n{i}", " ".join(rng.choices(WORDS, k=rng.choice([0, 4, 9]))) or None, rng.choice([None, [], ["SaaS"], ["saas", "B2B"], ["Bank!"]]), macro, rng.choice(["Brazil", "usa", "south brazil", "", None]),
            rng.choice(["1999", "2001", "2004", None, "x"]), "5", rng.choice(["Inactive", "Active", "Acquired", None]), rng.choice(["Lack of Funds", "Competition", None]), rng.choice([True, False, None]), rng.choice([None, [rng.gauss(0, 0.6), rng.gauss(0, 0.6)]]),
        )


def queries(rng, n):
    for i in range(n):
        yield (
            i, " ".join(rng.choices(WORDS, k=5)), " ".join(rng.choices(WORDS, k=6)), rng.choice([[], ["saas"], ["B2B", "bank"]]), rng.choice([[], ["fin"], ["fin", "ai"]]), rng.choice([None, "SaaS"]), rng.choice(["Brazil", "usa", None]),
            rng.choice(["2000", "", "2003"]), "7", None, rng.choice([None, "Lack of Funds", "competition"]), rng.choice([None, [], ["Competition", "Lack of Funds"]]), [0.5, rng.choice([0.1, -0.9])],
        )


@pytest.mark.parametrize("dense", [False, True])
def test_best_equals_scoring_all(spark, monkeypatch, dense):
    monkeypatch.setattr(retrieval, "BITS", 2)  # blocks of four
    monkeypatch.setattr(retrieval, "FIRST", 1)
    rng = random.Random(7 + dense)
    c, q = spark.createDataFrame(list(companies(rng, 150)), C), spark.createDataFrame(list(queries(rng, 12)), Q)
    if not dense:
        c, q = c.drop("embedding"), q.drop("embedding")
    asked = consult.Asked(consult.analyzed(q).drop("macros").join(q.select("query_id", "macros"), "query_id"), consult.Corpus(c))
    every = asked.corpus.blocks.crossJoin(asked.rows.select("query_id")).select("query_id", "block")
    want = scoring.ranked(asked.scored(every))
    for k in (1, 3, 10):
        got = retrieval.best(asked.bounds(), asked.scored, k)
        assert sorted((r.query_id, r.company_id, r["rank"]) for r in got.collect()) == sorted((r.query_id, r.company_id, r["rank"]) for r in want.where(F.col("rank") <= k).collect())
    # whatever reaches the least score lies in a block whose bound does
    reached = {(r.query_id, r.company_id) for r in asked.scored(asked.bounds().select("query_id", "block")).where("score >= 18").collect()}
    assert reached == {(r.query_id, r.company_id) for r in want.collect()}
    work = retrieval.work(asked.bounds(), retrieval.best(asked.bounds(), asked.scored, 1), 1, asked.corpus.blocks, asked.rows).first()
    assert work.scored <= work.reachable <= work.pairs == 12 * 150
    plan = got._jdf.queryExecution().toString()
    assert dense or "Cartesian" not in plan


@pytest.mark.parametrize("others", [False, True])
def test_best_by_kinds_equals_scoring_all(spark, monkeypatch, others):
    monkeypatch.setattr(retrieval, "BITS", 2)
    monkeypatch.setattr(retrieval, "FIRST", 1)
    rng = random.Random(11)
    some, asking = list(companies(rng, 30)), list(queries(rng, 6))
    c = spark.createDataFrame([(90 * n + r[0], *r[1:]) for n in range(3) for r in some], C).drop("embedding", "description").withColumn("own", F.col("company_id") * 2)
    q = spark.createDataFrame([(7 * n + r[0], *r[1:]) for n in range(4) for r in asking], Q).drop("embedding").withColumn("team_size", F.col("query_id").cast("string"))
    q = consult.analyzed(q).drop("macros").join(q.select("query_id", "macros"), "query_id")
    asked = consult.Asked(q, consult.Corpus(c, text=None))
    every = asked.scored(asked.corpus.blocks.crossJoin(asked.rows.select("query_id")).select("query_id", "block"))
    want = scoring.ranked(every.where("company_id <> query_id") if others else every)
    for k in (1, 4, 12):
        got = consult.best_by_kinds(q, c, k, others=others).collect()
        assert sorted((r.query_id, r.company_id, r["rank"]) for r in got) == sorted((r.query_id, r.company_id, r["rank"]) for r in want.where(F.col("rank") <= k).collect())
        assert got and all(r.own == 2 * r.company_id and r.q_team_size == str(r.query_id) for r in got)


@pytest.mark.parametrize("others", [False, True])
def test_best_with_texts_equals_scoring_all(spark, monkeypatch, others):
    monkeypatch.setattr(retrieval, "BITS", 2)
    monkeypatch.setattr(retrieval, "TOGETHER", 1)
    rng = random.Random(13)
    some, asking = list(companies(rng, 90)), list(queries(rng, 12))
    alike = [(100 * n + r[0], r[1], None if rng.random() < 0.4 else " ".join(rng.choices(WORDS[: rng.choice([4, 24])], k=rng.choice([1, 3, 8]))), *r[3:]) for n in range(4) for r in some[:40]]
    c = spark.createDataFrame(alike + [(1000 + r[0], *r[1:]) for r in some], C).drop("embedding")
    q = spark.createDataFrame([(100 * n + r[0], *r[1:]) for n in range(2) for r in asking], Q).drop("embedding")
    q = consult.coherence(consult.analyzed(q).drop("macros").join(q.select("query_id", "macros"), "query_id"))
    corpus = consult.Corpus(c)
    asked = consult.Asked(q, corpus)
    every = asked.scored(corpus.blocks.crossJoin(asked.rows.select("query_id")).select("query_id", "block"))
    want = scoring.ranked(every.where("company_id <> query_id") if others else every)
    fresh = consult.Corpus(c)
    for k in (5, 40):
        got = consult.best_with_texts(q, fresh, k, others).collect()
        told = [(r.query_id, r.company_id, r["rank"], round(r.score, 6)) for r in got]
        assert sorted(told) == sorted((r.query_id, r.company_id, r["rank"], round(r.score, 6)) for r in want.where(F.col("rank") <= k).collect())
        assert any(d.name == "lexical" for r in got for d in r.dims)
    assert not {"postings", "file"} & set(vars(fresh))  # no term of a query meets a block


def test_bounds_of_matches_grow_with_kinds_only(spark, monkeypatch, tmp_path):
    from peerlens.plans import match_queries

    monkeypatch.setattr(retrieval, "BITS", 2)
    met, best, read = [], retrieval.best, lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    monkeypatch.setattr(retrieval, "best", lambda candidates, *a, **b: met.append(candidates.count()) or best(candidates, *a, **b))
    for n in (1, 4):
        at = str(tmp_path / str(n))
        copies = spark.range(n).select((F.col("id") * 1_000_000).alias("_by"))
        read("nation").write.parquet(f"{at}/nation.parquet")
        for t, keys in (("customer", ["c_custkey"]), ("orders", ["o_custkey", "o_orderkey"])):
            read(t).crossJoin(copies).withColumns({x: F.col(x) + F.col("_by") for x in keys}).drop("_by").write.parquet(f"{at}/{t}.parquet")
        rows = match_queries.score_converged_topk(spark, at).groupBy("query_id").agg(F.max("rank").alias("n")).collect()
        assert len({r.query_id % 1_000_000 for r in rows}) * n == len(rows)
    assert met[0] == met[1] > 0


def test_an_empty_corpus_and_no_queries(spark):
    rng = random.Random(1)
    c, q = spark.createDataFrame(list(companies(rng, 5)), C), spark.createDataFrame(list(queries(rng, 2)), Q)
    assert consult.consult(q.drop("macros"), c.limit(0)).collect() == []
    assert consult.consult(q.drop("macros").limit(0), c).collect() == []


def test_segments_equal_counting(spark):
    rng = random.Random(5)
    rows = [(i, rng.sample(["a", "b", "c", "d"], rng.choice([0, 1, 2])), rng.choice(["dead", "acquired", "operating", "unknown", None]), rng.choice(["X y", "Z", "", None]), rng.choice([True, False, None]), rng.choice(["br", "us", None])) for i in range(300)]
    c = spark.createDataFrame(rows, "company_id int, macros array<string>, outcome string, cause string, cause_inferred boolean, country string")
    asked = [(1, ["a"], "x Y"), (2, ["b", "a", "b"], None), (3, [], "Z"), (4, ["zz"], "Z"), (5, None, None)]
    q = spark.createDataFrame(asked, "query_id int, macros array<string>, cause string")
    got = {r.query_id: r for r in segments.stats(q, segments.cells(c)).collect()}
    key = lambda s: "".join((s or "").lower().split())
    for query_id, macros, cause in asked:
        inside = [r for r in rows if set(r[1]) & set(macros or [])]
        n = Counter(r[2] or "unknown" for r in inside)
        r = got[query_id]
        assert (r.operating, r.acquired, r.dead, r.unknown, r.total) == (n["operating"], n["acquired"], n["dead"], n["unknown"], len(inside))
        assert r.matching == sum(key(x[3]) == key(cause) for x in inside)
        for name, inferred in (("documented", False), ("inferred", True)):
            counts = Counter(x[3] for x in inside if x[3] and bool(x[4]) == inferred)
            assert [(v.value, v.n) for v in r[name]] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        assert [(v.value, v.n) for v in r.countries] == sorted(Counter(x[5] for x in inside if x[5]).items(), key=lambda x: (-x[1], x[0]))
    t = segments.totals(segments.cells(c)).first()
    assert t.total == 300 and t.with_cause == sum(bool(r[3]) for r in rows) and sum(v.n for v in t.causes) == t.with_cause


def test_contrast_equals_means(spark):
    rng = random.Random(6)
    rows = [(i, rng.sample(["a", "b"], rng.choice([1, 2])), rng.choice(["dead", "acquired", "operating", "unknown"])) for i in range(60)]
    post = [(i, t, rng.random()) for i in range(60) for t in rng.sample(["term", "word", "thing", "xy", "other"], 3)]
    c, p = spark.createDataFrame(rows, "company_id int, macros array<string>, outcome string"), spark.createDataFrame(post, "company_id int, term string, w double")
    q = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["none"])], "query_id int, macros array<string>")
    got = sorted((r.query_id, r.side, r["rank"], r.term, r.support, round(r.delta, 9)) for r in segments.contrast(q, c, p, n=3).collect())
    want = []
    for query_id, macros in ((1, {"a"}), (2, {"a", "b"})):
        side = {i: o != "dead" for i, m, o in rows if o != "unknown" and set(m) & macros}
        size = Counter(side.values())
        sums, support = defaultdict(float), Counter()
        for i, t, w in post:
            if i in side and len(t) >= 3:
                sums[t, side[i]] += w
                support[t, side[i]] += 1
        for name, own in (("survivors", True), ("dead", False)):
            told = [(t, support[t, own], sums[t, own] / size[own] - sums[t, not own] / size[not own]) for t in {t for t, _ in sums}]
            told = sorted((x for x in told if x[2] > 0 and x[1] >= max(3, size[own] // 12)), key=lambda x: (-round(x[2], 9), x[0]))[:3]
            want += [(query_id, name, n, t, s, round(d, 9)) for n, (t, s, d) in enumerate(told, 1)]
    assert got == sorted(want)


def test_containment_both_ways(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab é", k=rng.choice([1, 2, 3, 5, 8])))
    a, b = [word() for _ in range(60)] + ["", None], [word() for _ in range(40)] + ["", None]
    left, right = spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(x,) for x in b], "y string")
    got = {(r.x, r.y) for r in containment.within_each_other(left, "x", right, "y").collect()}
    assert got == {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert containment.within_each_other(left.limit(0), "x", right, "y").count() == 0


def test_macros_of_categories(spark, monkeypatch):
    keywords = containment.keyword_table(spark, {"fin": ["bank", "fintech"], "food": ["pizza delivery"], "edu": ["educacao"]})
    rows = [(1, ["Investment Banking", "x"]), (2, ["Pizza"]), (3, ["EDUCAÇÃO", None, ""]), (4, []), (5, None), (6, ["Tech", "bank"])]
    df = spark.createDataFrame(rows, "id int, categories array<string>")
    want = {1: ["fin"], 2: ["food"], 3: ["edu"], 4: [], 5: [], 6: ["fin"]}
    assert {r.id: r.macros for r in containment.with_macros(df, keywords).collect()} == want
    monkeypatch.setattr(containment, "MAP_ROWS", 0)
    assert {r.id: r.macros for r in containment.with_macros(df, keywords).collect()} == want


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_corrections_equal_edit_distances(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.choice([4, 5, 6]))) for _ in range(150)]
    vocabulary = {"".join(rng.choices("abc", k=rng.choice([3, 4, 5, 6]))): rng.randrange(1, 5) for _ in range(120)}
    want = {}
    for w in set(words):
        near = [(-n, v) for v, n in vocabulary.items() if len(w) >= 5 and w not in vocabulary and len(v) >= 4 and v[0] == w[0] and osa(w, v) <= 1]
        if near:
            want[w] = min(near)[1]
    got = textindex.fuzzy_corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(vocabulary.items()), "term string, df long"))
    assert {r.word: r.correction for r in got.collect()} == want


def test_scores_of_all_pairs_from_cells(spark):
    from peerlens.plans import match_queries

    rows = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], 2000 + i % 2, "dead") for i in range(0, 1200, 10)], "company_id long, category string, country string, founded_year int, outcome string")
    cells = match_queries._scored_cells(rows)
    assert cells.count() == 1 and cells.first().n == 119  # one kind of company, whatever the number of those that ask


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_score_dimensions_has_every_pair(spark):
    from peerlens.plans import analogs, match_queries

    rows = analogs.companies(spark, "/root/testdata/sf0.001")
    found = match_queries.score_dimensions(spark, "/root/testdata/sf0.001")
    assert found.select("query_id", "company_id").distinct().count() == found.count() == rows.where(analogs.ASKED).count() * (rows.count() - 1)
    # pairs arise behind the last shuffle and join, from lists of those that ask
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("Generate explode") < min(plan.find(x) for x in ("Join", "Repartition"))
