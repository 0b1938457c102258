"""Selectors against a plain matcher, grids against hand-made tables, company pages and lists against their markup."""

import random

import pytest
from pyspark.sql import functions as F

from peerlens.sources import company_page, dom


def pages(spark, *html, url="https://h.io/company/acme-1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")


def random_page(rng):
    out, open_ = [], []
    for _ in range(60):
        if open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        else:
            tag = rng.choice(["div", "section", "span", "b"])
            attrs = rng.choice(["", ' class="a"', ' class="a b"', ' id="x"', ' data-k="one two"', ' class="b" href="/p/q"'])
            out.append(f"<{tag}{attrs}>t")
            open_.append(tag)
    return "".join(out)


def plain_match(path, steps, k):
    """Does the element at the end of path meet steps[: k + 1]?"""
    child, (tag, need) = steps[k]
    own = path[-1]
    if (tag and own["tag"] != tag) or not need(own):
        return False
    if k == 0:
        return True
    above = [path[:-1]] if child else [path[:i] for i in range(1, len(path))]
    return any(p and plain_match(p, steps, k - 1) for p in above)


CASES = {
    "div": [(False, ("div", lambda e: True))],
    "div .a": [(False, ("div", lambda e: True)), (False, ("", lambda e: "a" in e["classes"]))],
    "section > .b span": [(False, ("section", lambda e: True)), (True, ("", lambda e: "b" in e["classes"])), (False, ("span", lambda e: True))],
    "#x > div.a.b": [(False, ("", lambda e: e["id"] == "x")), (True, ("div", lambda e: {"a", "b"} <= set(e["classes"])))],
    'b[href^="/p"] div[data-k~=two]': [(False, ("b", lambda e: e["attrs"].get("href", "").startswith("/p"))), (False, ("div", lambda e: "two" in e["attrs"].get("data-k", "").split()))],
    "div > div > div": [(False, ("div", lambda e: True)), (True, ("div", lambda e: True)), (True, ("div", lambda e: True))],
}


def test_selectors_equal_a_plain_matcher(spark):
    rng = random.Random(3)
    found = dom.nodes(pages(spark, *[random_page(rng) for _ in range(12)], None, ""))
    rows = found.select("path", *[dom.matches(s).alias(f"m{i}") for i, s in enumerate(CASES)], dom.matches("b, .a[href]").alias("either")).collect()
    assert len(rows) > 200
    for r in rows:
        path = [{**s.asDict(), "attrs": dict(s.attrs)} for s in r.path]
        for i, steps in enumerate(CASES.values()):
            assert r[f"m{i}"] == plain_match(path, steps, len(steps) - 1)
        assert r.either == (path[-1]["tag"] == "b")
    for i in range(len(CASES)):
        assert any(r[f"m{i}"] for r in rows), list(CASES)[i]


@pytest.mark.parametrize("selector", ["", "> a", "a >", "a[", "a + b", "a ~ b", "a::x"])
def test_what_is_no_selector_is_refused(selector):
    with pytest.raises(ValueError):
        dom._steps(selector)


def test_open_elements_end_where_the_next_begins(spark):
    (page,) = pages(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<div>g<br>h</div><script>no</script>&amp; i").collect()
    tree = dom.Tree(page.html)
    assert [(e.tag, " ".join("".join(e.texts).split()), e.parent.tag if e.parent else None) for e in tree.elements if e.tag in ("li", "p", "div")] == [("li", "a", "ul"), ("li", "bc", "ul"), ("li", "c", "ul"), ("li", "d", "ul"), ("p", "e", None), ("p", "f", None), ("div", "gh", None)]


def test_cells_that_span_stand_in_each_place(spark):
    html = '<table><tr><th>A<th colspan=2>B</tr><tr><td rowspan="2">1<td>2<td>3<tr><td>4<td><a href="/x">5</a><table><tr><td>in</table></table>'
    got = {(r.grid, r.row, r.col): (r.header, r.text, r.links) for r in dom.grids(pages(spark, html, None)).collect()}
    assert {k: v[1] for k, v in got.items() if k[0] == 0} == {(0, 0, 0): "A", (0, 0, 1): "B", (0, 0, 2): "B", (0, 1, 0): "1", (0, 1, 1): "2", (0, 1, 2): "3", (0, 2, 0): "1", (0, 2, 1): "4", (0, 2, 2): "5 in"}
    assert got[0, 0, 2][0] and got[0, 2, 2][2] == ["/x"] and got[1, 0, 0][1] == "in"


PAGE = """<html><head><title>Acme - site</title><meta property="og:title" content="Acme Pay (Winter 2012) | site"><meta name="description" content="Pays things"><meta property="og:image" content="/l.png"></head><body>
<nav><p>menu</p><a href="/company/acme-1/">me</a></nav><span class="badge"> inactive </span><a href="/browse/category/fin">Fintech</a><a href="/browse/category/fin">Fintech</a><a href="https://x.com/a">x</a><a href="https://acme.io">site</a>
<a href="https://www.ycombinator.com/companies/acme">yc</a><a href="/company/rival/">Rival</a><div>Location: Oslo, Norway</div><div>Founded: 2011</div><div>Team Size: 1,200</div><div>Total Raised: $12.5M</div><div>Founders</div><div>Ann Lee</div><div>Bo van Dyk</div><p>It was acquired by Big Corp, later.</p>
<h2>Overview</h2><p>One.</p><ul><li>item a<p>inner</p></li></ul><h3>More</h3><p>Two.</p><h2>Market Position</h2><p>It competes with Rival Inc and vs. Other.</p><h2>Why it failed</h2><p>No cash.</p><h2>Sources</h2><ul><li>s1</li></ul><p>s2</p><h2>Rebuild plan</h2><p>x</p></body></html>"""


def test_company_page(spark):
    a, b = company_page.companies(pages(spark, PAGE, None)).orderBy("page_id").collect()
    assert (a.slug, a["name"], a.one_liner, a.logo_url, a.status) == ("acme-1", "Acme Pay (Winter 2012)", "Pays things", "/l.png", "Inactive")
    assert (a.yc_batch, a.yc_batch_season, a.yc_batch_year, a.categories, a.website) == ("Winter 2012", "Winter", "2012", ["Fintech"], "https://acme.io")
    assert (a.yc_url, a.location, a.founded_year, a.team_size, a.total_funding) == ("https://www.ycombinator.com/companies/acme", "Oslo, Norway", "2011", "1,200", "12.5M")
    assert (a.founders, a.acquirer, a.report_locked, a.related) == (["Ann Lee"], "Big Corp", False, ["rival"])
    assert (a.overview.content, a.overview["items"], a.post_mortem.content, a.sources, a.build_plan) == ("One.\nTwo.", ["item a inner"], "No cash.", ["s1", "s2"], "Rebuild plan")
    assert a.competitors == ["Rival Inc", "Other"] and a.report_available and a.traction is None
    assert (b.slug, b["name"], b.status, b.categories, b.report_available) == ("acme-1", "", "", [], False)


def test_lists_of_companies(spark):
    head = "<tr><th>Company Details<th>Short Description<th>Funding Date<th>Total Funding<th>Top Investors<th>Stage<th>Founded</tr>"
    row = '<tr><td><a href="/d/companies/acme">Acme2012</a>, Oslo, Seed<td>pays<td>x<td>$5M<td>One Fund, Two & 3 others<td>{}<td>{}</tr>'
    table = f"<table>{head}{row.format('Public', '2013')}{row.format('', 'soon')}<tr><td><td>no name</tr><tr><td>, Plain ,<td></tr></table>"
    other = table.replace("Funding Date", "Round Raised").replace("Acme", "No")
    got = [tuple(r)[3:] for r in company_page.table_companies(dom.grids(pages(spark, table + other + "<table><tr><td>x</table>"))).orderBy("grid", "row").collect()]
    assert got == [
        ("Acme", "pays", "2013", "Oslo", "Public", "$5M", ["One Fund", "Two"], "/d/companies/acme"),
        ("Acme", "pays", "2012", "Oslo", "Seed", "$5M", ["One Fund", "Two"], "/d/companies/acme"),
        ("Plain", "", "", "", "", "", [], ""),
    ]
    assert company_page.table_companies(dom.grids(pages(spark, None))).collect() == []


def test_one_parse_serves_many_selectors(spark):
    found = dom.nodes(pages(spark, PAGE))
    plan = found.select(F.count_if(dom.matches("p")).alias("p"), F.count_if(dom.matches("nav a")).alias("a"))
    assert plan.first().asDict() == {"p": 9, "a": 1} and plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_page_elements_of_each_row(spark, tmp_path):
    from peerlens.plans import page_queries

    page = "<html lang='en'><head><title>a &amp; b&amp</title></head><body><p>x<a href='/y?a=1&copy=2'>z</a></body></html>"
    spark.createDataFrame([(1, page), (1, page), (2, ""), (3, "plain"), (4, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.anchors, r.own_links, r.title, r.bodies) for r in page_queries.page_elements(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "/y?a=1&copy=2", "a & b&amp", 0)] * 2 + [(2, 0, "", "", 0), (3, 0, "", "", 0)]


def test_references_of_page_elements_equal_the_sql(spark, tmp_path):
    import duckdb

    from peerlens.plans import page_queries, registry

    titles = ["token = &quot;7&quot;", "a &amp;lt; b &lt;i&gt; &nbsp;c&#39;d", "&amp;amp;quot; &eacute;&lt"]
    made = [(i, f'<html lang="e&amp;n"><head><title> {t}\n</title></head><body><p>x &quot;<a href="/y?a=1&amp;b={i}">z</a><a href="/&quot;">q</a></p></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(made, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = page_queries.page_elements(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(registry.ORACLES["page_elements"]).project(", ".join(found.columns)).fetchall())


def test_listicle_pages_hold_a_bounded_number_of_cards(spark, tmp_path, monkeypatch):
    from peerlens.plans import page_queries

    spark.range(1700).selectExpr("id as c_custkey", "concat('C', id) as c_name", "3 as c_nationkey", "'seg' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(3, "LAND")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    made, whole = [], page_queries.dom.nodes
    monkeypatch.setattr(page_queries.dom, "nodes", lambda pages: made.append(pages) or whole(pages))
    found = page_queries.listicle_companies(spark, str(tmp_path))
    assert found.count() == 1700 and {(r.page_id, r.list_label) for r in found.select("page_id", "list_label").distinct().collect()} == {(3, "Failures of LAND")}
    assert max(r.html.count("<h3") for r in made[0].collect()) <= page_queries.CARDS


def test_rows_of_lists_come_from_one_parse(spark, tmp_path):
    from peerlens.plans import page_queries

    spark.range(40).selectExpr("id as l_orderkey", "id % 3 as l_suppkey", "id as l_partkey", "cast(id % 5 as int) as l_linenumber", "id * 1.5D as l_quantity", "id * 2.5D as l_extendedprice", "'R' as l_returnflag", "date'1997-01-02' as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = page_queries.listed_companies(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and found.count() == 40


def test_rows_of_grids_are_those_of_their_cells(spark):
    html = '<table><tr><th>Company<th>Stage<tr><th>row<td>A<td>Seed</table><table><tr><td>Acme2012, Oslo<td rowspan=2>Public<tr><td>Bee<tr><th>Startup<th>Round raised</table><table><tr><td>C<td>D<tr><th>Stage<th>Company name<th>Company name</table>'
    both = [sorted(map(tuple, f.collect())) for f in (company_page.table_companies(dom.grids(pages(spark, html))), company_page.row_companies(dom.grid_rows(pages(spark, html))))]
    assert both[0] == both[1] and [r[1:4] for r in both[1]] == [(2, 0, "D")]


def test_plain_markup_is_cut_as_the_parser_reads_it(monkeypatch):
    rng = random.Random(5)
    bits = [*"<p> </p> <div> </div> <table> <tr> <td> <th> </table> <ul> <li> </ul> <br> <title> </title> <P> <script> </script> <br/> < <!--x--> <b>".split(" "), '<a href="/x?a=1&b=2">', '<td rowspan="2" ROWSPAN="3">', "text", " &amp; &copy &notit; ", "&", "\n"]
    made = lambda page: [(e.tag, e.attrs, list(e.own), e.texts, e.parent and e.parent.number) for e in dom.Tree(page).elements]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 15)))
        got = made(page)
        with monkeypatch.context() as m:
            m.setattr(dom.Tree, "_plain_markup", lambda self, text: False)
            assert made(page) == got, page


def test_pages_of_companies_are_dealt_over_tasks(spark, tmp_path):
    from peerlens.plans import page_queries

    spark.range(400).selectExpr("id as c_custkey", "concat('C', id) as c_name", "1 as c_nationkey", "'seg' as c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "LAND")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(5, "Told.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = page_queries._company_pages(spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(held) >= 8 and max(held) < 200 and sum(held) == 400
