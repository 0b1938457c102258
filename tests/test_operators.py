import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import cohorts, graph, lifecycle, linkage, quality, scoring, textindex, vectors


def test_merge_is_independent_of_row_order(spark):
    rows = [("a", 0, 0, "acme", "", ["x", ""]), ("b", 1, 0, "acme", "Acme", ["y", "x"]), ("c", 2, 0, "acme", "ACME", None), ("a", 0, 1, "", "nokey", [])]
    got = []
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "source string, source_ord int, record_ord int, norm string, name string, categories array<string>")
        (m,) = linkage.merge_records(df, ["name"], ["categories"]).collect()
        got.append(m.asDict(recursive=True))
    assert got[0] == got[1]
    assert got[0]["name"] == "Acme" and got[0]["categories"] == ["x", "y"] and got[0]["sources"] == ["a", "b", "c"] and got[0]["aliases"] == ["ACME"]
    assert [e["value"] for e in got[0]["provenance"]["name"]] == ["Acme", "ACME"]


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([("a", 0, 0, "k", "N", ["x"])] * 2, "source string, source_ord int, record_ord int, norm string, name string, categories array<string>")
    (m,) = linkage.merge_records(df, ["name"], ["categories"]).collect()
    assert (m["name"], m.categories, m.sources) == ("N", ["x"], ["a"])


def test_merge_counts_statements_and_keeps_raw_records(spark):
    rows = [("a", 0, i, "acme", "Acme" if i % 2 else "ACME", ["x"]) for i in range(6)] + [("b", 1, 0, "acme", " ", None), ("b", 1, 1, "lone", None, None)]
    df = spark.createDataFrame(rows, "source string, source_ord int, record_ord int, norm string, name string, categories array<string>")
    got = {r.norm: r for r in linkage.merge_records(df, ["name"], ["categories"], raw=True).select("*", F.expr("variant_get(raw_per_source['a'], '$.record_ord', 'int')").alias("last")).drop("raw_per_source").collect()}
    assert [(e.source, e.value, e.n) for e in got["acme"].provenance["name"]] == [("a", "ACME", 3), ("a", "Acme", 3)]
    assert (got["acme"]["name"], got["acme"].aliases, got["acme"].sources, got["acme"]["last"]) == ("ACME", ["Acme"], ["a", "b"], 5)
    assert (got["lone"]["name"], got["lone"].categories, got["lone"].provenance, got["lone"].sources) == (None, [], {}, ["b"])
    assert linkage.merge_records(df.limit(0), ["name"], ["categories"]).collect() == []


def test_patches_do_not_multiply_rows(spark):
    df, patches = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "x"), (9, "z")], "k int, v string")
    done, misses = linkage.apply_patches(df, patches, "k", ["v"])
    assert sorted(map(tuple, done.collect())) == [(1, "x"), (1, "x"), (2, "c")] and [r.k for r in misses.collect()] == [9]


def test_upsert_policies(spark):
    s = "k string, a string, t string, l array<string>, outcome string"
    old = spark.createDataFrame([("1", "old", "long text", ["x"], "unknown"), ("2", "", "", None, "dead")], s)
    new = spark.createDataFrame([("1", "new", "short", ["x", "y"], "dead"), ("2", "n", "t", ["z"], "operating"), ("3", "c", "t", [], None)], s)
    got = {r.k: r for r in linkage.upsert(old, new, "k", {"a": "fill", "t": "longest", "l": "union", "outcome": "outcome"}).collect()}
    assert (got["1"].a, got["1"].t, got["1"].l, got["1"].outcome) == ("old", "long text", ["x", "y"], "dead")
    assert (got["2"].a, got["2"].l, got["2"].outcome) == ("n", ["z"], "dead") and got["3"].a == "c"


def test_collision_suffix(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "slug string, o int")
    assert sorted(r.id for r in linkage.with_suffix_on_collision(df, "slug", ["o"], "id").collect()) == ["a", "a-2", "b"]
    many = spark.createDataFrame([("s", i) for i in range(500)] + [(None, 1), (None, 2)], "slug string, o int").repartition(7)
    got = {(r.slug, r.o): r.n for r in linkage.numbered_within(many, "slug", ["o"], "n").collect()}
    assert got == {("s", i): i + 1 for i in range(500)} | {(None, 1): 1, (None, 2): 2}


def test_era_and_semantic_values(spark):
    row = spark.range(1)
    era = [row.select(scoring.era(F.lit(2010), F.lit(2010 + d)).alias("d")).first().d for d in range(5)]
    assert [round(d.value, 3) if d else None for d in era] == [1.0, 0.875, 0.646, 0.35, None]
    values = [row.select(scoring.semantic_value(F.lit(x)).alias("v")).first().v for x in (0.22, 0.46, 0.7, 0.9)]
    assert [round(v, 3) for v in values] == [0.0, 0.5, 1.0, 1.0]


def test_worked_score(spark):
    dims = [scoring.overlap("macro", F.array(F.lit("m")), F.array(F.lit("m")), 16.0), scoring.overlap("category", F.array(F.lit("c")), F.array(F.lit("c")), 10.0), scoring.lexical(F.lit(0.2)), scoring.country(F.lit("brazil"), F.lit("brazil")), scoring.era(F.lit(2010), F.lit(2011))]
    r = scoring.with_score(spark.range(1), dims, F.lit(True)).first()
    assert r.convergence and r.score == pytest.approx(16 + 10 + 3 + 7 + 4.375 + 20)


def test_rerank_keeps_the_tail(spark):
    rows = spark.createDataFrame([(1, i, 100.0 - i, i, 0.0 if i == 1 else 1.0) for i in range(1, 6)], "query_id int, company_id int, score double, rank int, sim double")
    got = [r.company_id for r in scoring.rerank(rows, "sim", head=3).orderBy("final_rank").collect()]
    assert got == [2, 3, 1, 4, 5]


def test_cohort_collapse_counts_ten_peers(spark):
    rows = [(i, "m", "2010s", "br", 2015 + i % 3, "dead") for i in range(11)] + [(50, "m", "2010s", "br", 2030, "dead"), (51, "m", "2010s", "br", None, "operating")]
    df = spark.createDataFrame(rows, "company_id int, macro string, decade string, country string, shutdown_year int, outcome string").withColumn("macros", F.array("macro"))
    got = {r.company_id: r.peers_co_dying for r in cohorts.with_cohort_peers(df).collect()}
    assert got[0] == 10 and got[50] == 0 and got[51] == 0


def test_path_signal(spark):
    s = "query_id int, dead long, total long"
    top = spark.createDataFrame([(1, 8, 10), (2, 1, 10), (3, 5, 10), (4, 5, 10), (6, 5, 10)], s)
    seg = spark.createDataFrame([(1, 10, 40), (2, 20, 40), (3, 20, 40), (4, 1, 5), (5, 1, 50)], s)
    got = {r.query_id: r.direction for r in cohorts.path_signal(top, seg, ["query_id"]).collect()}
    assert got == {1: "NEGATIVO", 2: "POSITIVO", 3: "NEUTRO", 4: "INCERTO", 5: "SEM_MATCHES", 6: "SEM_SEGMENTO"}


def test_lifecycle_scenario(spark):
    t0 = dt.datetime(2024, 1, 1)
    companies = spark.createDataFrame([(1, "a@x.org", True, t0, "active"), (2, "", True, t0, "active"), (3, "c@x.org", False, t0, "active")], "company_id int, email string, consent_followup boolean, created_at timestamp_ntz, current_status string")
    queue = lifecycle.schedule(companies)
    assert [(r.company_id, r.days_offset) for r in queue.orderBy("days_offset").collect()] == [(1, 90), (1, 180), (1, 365), (1, 730)]
    assert lifecycle.schedule(companies, queue).count() == 0
    now = F.lit("2024-07-19 00:00:00").cast("timestamp_ntz")
    assert lifecycle.due(queue, companies, now).count() == 2
    full = queue.withColumns({"token": F.concat("company_id", F.lit("-"), "days_offset"), "sent_at": F.lit(None).cast("timestamp_ntz"), "responded_at": F.lit(None).cast("timestamp_ntz")})
    sent = lifecycle.marked_sent(full, lifecycle.due(full, companies, now), now)
    assert sent.where("status = 'sent'").count() == 2
    answers = spark.createDataFrame([("1-90", dt.datetime(2024, 7, 20)), ("1-90", dt.datetime(2024, 7, 25))], "token string, responded_at timestamp_ntz")
    done = lifecycle.responded(sent, answers)
    assert [r.responded_at for r in done.where("status = 'responded'").collect()] == [dt.datetime(2024, 7, 20)]
    assert lifecycle.responded(done, answers).collect() == done.collect()
    assert lifecycle.opted_out(done, companies).where("status = 'opted_out'").count() == 2
    snapshots = spark.createDataFrame([(1,), (1,), (2,)], "company_id int")
    assert [r.company_id for r in lifecycle.promotion_candidates(companies, snapshots, now).collect()] == [1]
    nodes = spark.createDataFrame([(1, "n1"), (2, "n2")], "company_id int, name string")
    c, q, n = lifecycle.erase(companies, done, nodes, companies.where("company_id = 1"))
    assert c.count() == 2 and q.count() == 0 and sorted(r.name for r in n.collect()) == ["[deleted]", "n2"]


def test_graph_exports(spark, tmp_path):
    e = spark.createDataFrame([("A", "B", "R"), ("A", "B", "R"), ("A", "C", "R")], "source string, target string, relation string")
    edges = graph.distinct_edges([e])
    nodes = graph.nodes_of([spark.createDataFrame([("A", "company", "a"), ("B", "x", "b")], "id string, type string, name string")], edges)
    assert {r.id: r.type for r in nodes.collect()} == {"A": "company", "B": "x", "C": "unknown"}
    graph.write_bulk(nodes, edges, str(tmp_path / "bulk"))
    assert spark.read.csv(str(tmp_path / "bulk/edges"), header=True).columns == [":START_ID", ":END_ID", ":TYPE"]
    graph.write_xml(nodes, edges, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "node").load(str(tmp_path / "xml/nodes")).count() == 3
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "A"}], "links": [{"source": "A", "target": "B"}]}')
    n, links = graph.read_node_link(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and links.first().target == "B"


def test_systematic_sample(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v int")
    assert sorted(r.v for r in graph.systematic_sample(df, ["v"], 4).collect()) == [0, 2, 5, 7]


def test_quality(spark):
    df = spark.createDataFrame([("", 1), ("x", 2), (None, 3), ("y", 4)], "a string, n int")
    assert quality.fill_rates(df, ["a"]).first().rate == 0.5
    assert quality.upper_median(df.withColumn("g", F.lit(1)), "g", "n", "m").first().m == 3
    kinds = spark.createDataFrame([("",), ("see the paid plan " * 5,), ("short",), ("a real section " * 5,)], "s string").select(quality.section_kind(F.col("s"), ["paid plan"]).alias("k"))
    assert [r.k for r in kinds.collect()] == ["empty", "pro_only", "weak", "real"]


def test_topk_and_fuzzy(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta"), (3, ""), (4, "alpha beta gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(9, "beta gamma")], "item_id int, text string")
    assert [(r.doc_id, r.rank) for r in textindex.cosine_topk(q, "item_id", docs, "doc_id").orderBy("rank").collect()] == [(1, 1), (4, 2)]
    v = spark.createDataFrame([("market", 5), ("marked", 9)], "term string, df long")
    got = textindex.fuzzy_corrections(spark.createDataFrame([("markex",), ("market",), ("abc",)], "word string"), v).collect()
    assert [(r.word, r.correction) for r in got] == [("markex", "marked")]


def test_kmeans_invariants(spark):
    rows = [(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    model = vectors.kmeans(df, k=2, starts=1)
    sizes = sorted(r["count"] for r in vectors.with_cluster(df, model).groupBy("cluster_id").count().collect())
    assert sizes == [10, 10] and model.summary.trainingCost == pytest.approx(0)
    encoded = vectors.encode_texts(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert [r.embedding for r in encoded.collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_topk_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id int, embedding array<float>")
    q = df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    one = sorted(map(tuple, vectors.topk(q, "query_id", df, "vec_id", k=2).collect()))
    assert one == sorted(map(tuple, vectors.topk(q, "query_id", df, "vec_id", k=2, block=2).collect())) and len(one) == 10


def test_kmeans_profile_takes_the_defaults(spark, monkeypatch, tmp_path):
    from peerlens.operators import vectors
    from peerlens.plans import catalogue

    rows = [(i, i % 3, [float(i % 60), float(i % 7)]) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    fits = []
    fit = vectors.KMeans.fit
    monkeypatch.setattr(vectors.KMeans, "fit", lambda self, df: fits.append((self.getK(), self.getMaxIter())) or fit(self, df))
    assert catalogue.QUERIES["kmeans_profile"](spark, str(tmp_path)).count() == 50
    assert fits == [(50, 200)] * 4


def test_inverted_file_recall(spark):
    """Every vector whose id is divisible by 100 against all, with the registered number of probes, against the exact search."""
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    e = spark.read.parquet(path)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.topk(asked, "query_id", e, "vec_id").collect()}
    near = vectors.ivf_topk(asked, "query_id", e, "vec_id", vectors.centroids(e, "label"))
    found = {(r.query_id, r.vec_id) for r in near.collect()}
    assert len(found & exact) / len(exact) >= 0.9
    # more queries than a block are dealt with salts, and give the same
    dealt = vectors.ivf_topk(asked, "query_id", e, "vec_id", vectors.centroids(e, "label"), block=2)
    assert {(r.query_id, r.vec_id) for r in dealt.collect()} == found
    few = {(r.query_id, r.vec_id) for r in vectors.topk(asked, "query_id", e, "vec_id", block=2).collect()}
    assert few == exact


def test_products_above_a_bound(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(40)] + [(40, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = asked.withColumnRenamed("embedding", "q").crossJoin(e).where("query_id <> vec_id").select("query_id", "vec_id", vectors.dot(F.col("q"), F.col("embedding")).alias("score")).where("score >= 0.2")
    want = sorted(map(tuple, pairs.collect()))
    for block in (vectors.BLOCK, 2):
        assert sorted(map(tuple, vectors.above(asked, "query_id", e, "vec_id", 0.2, block=block).collect())) == want


def test_terms_are_counted_where_the_documents_lie(spark):
    """No shuffle by document and term; documents that share a key are counted together as before."""
    from peerlens.operators import textindex

    docs = [(1, "tree tree river lake tree"), (2, None), (3, ""), (4, "lake"), (None, "river river")]
    want = {(1, "tree", 3, 5), (1, "river", 1, 5), (1, "lake", 1, 5), (4, "lake", 1, 1), (None, "river", 2, 2)}
    once = textindex.term_counts(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    assert {(r["id"], r["term"], r["n"], r["total"]) for r in once.collect()} == want and once.count() == len(want)
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    twice = textindex.term_counts(spark.createDataFrame([*docs, docs[0]], "id int, text string"), "id", "text")
    assert {(r["id"], r["term"], r["n"]) for r in twice.collect() if r["id"] == 1} == {(1, "tree", 6), (1, "river", 2), (1, "lake", 2)}


def test_kmeans_goes_over_dealt_vectors(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id as vec_id", "array(cast(id % 3 as float), cast(id as float) / 100) as embedding").coalesce(1)
    made, whole = [], vectors.KMeans.fit
    monkeypatch.setattr(vectors.KMeans, "fit", lambda self, df: made.append(df.rdd.getNumPartitions()) or whole(self, df))
    model = vectors.kmeans(rows, k=3, starts=2)
    assert len(made) == 2 and min(made) >= 8 and sorted(r["count"] for r in vectors.with_cluster(rows, model).groupBy("cluster_id").count().collect()) == [20, 20, 20]
