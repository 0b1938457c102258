import datetime as dt

from pyspark.sql import functions as F

from peerlens.operators import lifecycle, reports
from peerlens.sources import html


def test_counts_and_sources(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("b", "x"), ("b", None)], "s string, c string")
    assert sorted(map(tuple, reports.counts(df, ["s", "c"], 1).collect())) == [("c", "x", 2), ("s", "a", 2)]
    records = spark.createDataFrame([("k1", "A"), ("k1", "B"), ("k2", "A"), ("k2", "A")], "norm string, source string")
    assert sorted(map(tuple, reports.source_summary(records).collect())) == [("A", 3, 2, 1), ("B", 1, 1, 1)]


def test_sections(spark):
    long = "a real section of some length, long enough"
    df = spark.createDataFrame([(1, long, long), (2, long, "paid plan only, sorry for that, dear reader"), (3, None, "short")], "id int, intro string, market string")
    got = {r.section: tuple(r)[1:] for r in reports.section_coverage(df, ["intro", "market"], ["paid plan"]).collect()}
    assert got == {"intro": (2, 0, 0, 1), "market": (1, 1, 1, 0)}
    assert [r.id for r in reports.complete_reports(df, "id", ["intro", "market"], ["paid plan"]).where("complete").collect()] == [1]


def test_meta_and_suggestions(spark):
    df = spark.createDataFrame([("Inactive", "Cash", "br", ["AI", "Bio"]), ("Active", "", "us", ["AI"])], "status string, cause string, country string, categories array<string>")
    assert tuple(reports.corpus_meta(df).first()) == (2, 1, 1, 2)
    known = reports.known_categories(df)
    assert [r.category for r in reports.suggestions(known, "a", []).collect()] == ["AI"]
    assert reports.suggestions(known, "a", ["AI"]).count() == 0
    labels = spark.createDataFrame([(["x", "y"],), (["x"],)], "pattern_labels array<string>")
    assert [tuple(r) for r in reports.label_histogram(labels).collect()] == [("x", 2), ("y", 1)]
    matches = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 99, "C"), (1, 4, "")], "query_id int, final_rank int, cause string")
    assert [tuple(r) for r in reports.top_causes(matches, k=1).collect()] == [(1, "A", 2)]


def test_queries_and_snapshots(spark):
    q = spark.createDataFrame([(1, "N", "long enough line", ["a"], "c"), (2, "", "short", [], None)], "query_id int, name string, one_liner string, categories array<string>, main_concern string")
    assert [(r.query_id, r.reasons) for r in reports.rejected(q).collect()] == [(2, ["NAME", "ONE_LINER", "CATEGORIES", "MAIN_CONCERN"])]
    s = spark.createDataFrame([(7, "Old", "br", "1999", "saas"), (7, "New", "us", "2001", "app")], "company_id int, name string, country string, founded_year string, business_model string")
    taken = F.when(F.col("name") == "New", F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp")
    snaps = reports.snapshot(s, "initial", taken)
    answers = spark.createDataFrame([(7, "", None, "2010", "")], s.schema)
    assert tuple(reports.inherited(answers, snaps).first()) == (7, "New", "us", "2010", "app")


def test_register_and_promote(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "company_id long, norm string, email string, consent_followup boolean, created_at timestamp_ntz, updated_at timestamp_ntz, current_status string"
    companies = spark.createDataFrame([(1, "acme", None, False, t, t, "silent")], schema)
    new = spark.createDataFrame([("acme", "", True, t), ("beta", "b@x.org", True, t), ("beta", "b@x.org", False, dt.datetime(2024, 1, 2))], "norm string, email string, consent_followup boolean, submitted_at timestamp_ntz")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    got = lifecycle.registered(companies, new, now)
    rows = {r.norm: r for r in got.collect()}
    assert (rows["acme"].company_id, rows["acme"].consent_followup, rows["acme"].created_at) == (1, True, t)
    assert (rows["beta"].consent_followup, rows["beta"].current_status) == (False, "active") and len(rows) == 2
    snaps = spark.createDataFrame([(1, t, ("Acme", "br"))], "company_id long, taken_at timestamp_ntz, input struct<name: string, country: string>")
    corpus = spark.createDataFrame([("other", "Other", "Active", "us", ["x"])], "norm string, name string, status string, country string, sources array<string>")
    merged, after = lifecycle.promote(corpus, companies, snaps, companies.select("company_id"))
    assert {r.norm: (r["name"], r.status, r.sources) for r in merged.collect()} == {"other": ("Other", "Active", ["x"]), "acme": ("Acme", "Inactive", ["user"])}
    again, _ = lifecycle.promote(merged, companies, snaps, companies.select("company_id"))
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    assert [r.current_status for r in after.collect()] == ["promoted"]


def test_links(spark):
    page = '<a href="https://www.acme.io/x">Acme</a><a href="https://foo.com"></a><a href="https://z.org">About</a><a href="/c/steel">Steel</a>'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert sorted(r["name"] for r in html.portfolio(pages, ["about"]).collect()) == ["Acme", "foo"]
    assert [(r.slug, r["name"]) for r in html.taxonomy(pages, "/c/").collect()] == [("steel", "Steel")]
    t = spark.createDataFrame([("Companies of {year}",)], "template string")
    assert [r["name"] for r in html.expanded(t, 2008, 2009).orderBy("year").collect()] == ["Companies of 2008", "Companies of 2009"]
