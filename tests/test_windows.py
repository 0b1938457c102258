"""Sources read window by window, and adapters of dumps and pages."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.operators import quality
from peerlens.sources import adapters, windows


@pytest.mark.parametrize("split", [windows.halves, windows.singles])
def test_windows_that_fail_or_are_cut_off_are_split(spark, split):
    rows = spark.createDataFrame([(f, y, f"{f}{y}-{i}") for f, n in (("a", 3), ("b", 1)) for y in range(2000, 2020) for i in range(n)] + [("a", 2005, "b2001-0")] + [("b", 2013, f"much{i}") for i in range(30)], "f string, y int, id string")
    asked = []

    def fetch(pending):
        asked.append(pending.count())
        met = pending.join(rows, (F.col("facet") == F.col("f")) & F.col("y").between(F.col("first"), F.col("last")))
        met = met.where("not (facet = 'b' and first <= 2007 and last >= 2007)")  # 2007 never answers, nor does any window over it
        return met.withColumn("n", F.row_number().over(Window.partitionBy("facet", "first", "last").orderBy("y", "id"))).where("n <= 10").drop("n", "f")

    facets = spark.createDataFrame([("a",), ("b",), ("none",)], "facet string")
    found, left = windows.fetched(windows.covering(facets, 2000, 2019, 5), fetch, "id", 10, spark.createDataFrame([("a2000-0",)], "id string"), split)
    got = [r.id for r in found.collect()]
    want = {r.id for r in rows.collect() if not (r.f == "b" and r.y in (2007, 2013))} - {"a2000-0"}
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) == 10  # ten of the year that is cut off
    assert {(r.facet, r["first"]) for r in left.collect() if r.facet != "none"} == {("b", 2007), ("b", 2013)} and len(asked) <= 5
    assert [r.rows for r in left.where("facet = 'b' and first = 2013").collect()] == [10]


def test_dump_and_encyclopedia_adapters(spark, tmp_path):
    dump = [{"name": "Acme Inc", "slug": "acme", "one_liner": "pays", "team_size": 5, "post_mortem": {"content": "no cash", "items": []}, "sources": ["s1", ""], "founders": ["Ann"]}, {"slug": "lone", "description": "d", "post_mortem": None}, {"name": " "}]
    (tmp_path / "d.json").write_text(json.dumps(dump))
    a, b = adapters.ADAPTERS["dump"](spark, str(tmp_path / "d.json")).orderBy("norm").collect()
    assert (a.norm, a.description, a.headcount, a.post_mortem, a.links, a.founders) == ("acme", "pays", "5", "no cash", ["s1"], ["Ann"])
    assert (b["name"], b.description, b.post_mortem, b.links) == ("lone", "d", None, [])
    (tmp_path / "e.json").write_text(json.dumps({"title": "Foo (firm)", "extract": "Foo is defunct.", "wikitext": "{{Infobox\n| founded = 1990\n}}"}) + "\n")
    (e,) = adapters.ADAPTERS["encyclopedia"](spark, str(tmp_path / "e.json")).collect()
    assert (e["name"], e.status, e.founded_year) == ("Foo", "Inactive", "1990")


def test_page_adapters(spark, tmp_path):
    card = '<div class="listicle-startup-collection-item"><h3 class="listicle-h3">Gone</h3><p class="content-paragraph">did x</p><ul><li class="listicle-list-item"><b class="listicle-list-category">Founders:</b> <i class="failed-startup-list-information">A B & C and D</i></li></ul><a href="/cemetery/gone">x</a></div>'
    table = '<table><tr><th>Company<th>Stage<tr><td>Here<td>Seed</table>'
    page = '<head><meta property="og:title" content="Acme | x"></head><body><h2>Post-mortem</h2><p>No cash.</p></body>'
    spark.createDataFrame([(1, "https://h/company/acme", card + table + page), (2, None, None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    found = {n: adapters.ADAPTERS[n](spark, str(tmp_path / "p")).collect() for n in ("listicle", "listed", "company_pages")}
    assert [(r.norm, r.description, r.founders, r.links, r.status) for r in found["listicle"]] == [("gone", "did x", ["A B", "C", "D"], ["/cemetery/gone"], "Inactive")]
    assert [(r.norm, r.status) for r in found["listed"]] == [("here", "Seed")] and [(r.norm, r.post_mortem) for r in found["company_pages"]] == [("acme", "No cash.")]


def test_quality_of_no_reports(spark):
    s = "struct<content: string, items: array<string>, subsections: array<string>>"
    df = spark.createDataFrame([], f"overview {s}, sources array<string>, build_plan struct<title: string, content: string, items: array<string>, subsections: array<string>>")
    assert {(r.kind, r.n) for r in quality.report_quality(df, ["overview"], ["go pro"]).collect() if r.n is not None} == {("strict_sections", 0), ("total", 0)}
    one = spark.createDataFrame([(None, None, None), (("x" * 90, None, None), ["y" * 70], ("t", "z" * 90, None, None))], df.schema)
    got = {(r.kind, r.key): (r.strict, r.loose, r.n) for r in quality.report_quality(one, ["overview"], ["go pro"]).collect()}
    assert got["section", "overview"] == (1, 1, None) and got["strict_sections", "0"][2] == 1 and got["total", "complete"][2] == 1


def test_a_window_of_one_number_comes_whole_in_parts(spark):
    rows = spark.createDataFrame([("b", 2013, f"much{i}") for i in range(300)] + [("b", 2011, "one")], "f string, y int, id string")

    def fetch(pending):
        met = pending.join(rows, (F.col("facet") == F.col("f")) & F.col("y").between(F.col("first"), F.col("last")) & (windows.part_of(F.col("id"), F.col("parts")) == F.col("part")))
        return met.withColumn("n", F.row_number().over(Window.partitionBy("facet", "first", "last", "parts", "part").orderBy("id"))).where("n <= 40").drop("n", "f")

    facets = spark.createDataFrame([("b",)], "facet string")
    found, left = windows.fetched(windows.covering(facets, 2010, 2013, 4), fetch, "id", 40, dealt=True)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in rows.collect())
    assert {r["first"] for r in left.collect()} == {2012}  # without an answer
