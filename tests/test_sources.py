import random

from pyspark.sql import functions as F

from peerlens.operators import linkage
from peerlens.sources import adapters, html


def test_register(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("CNPJ_CIA;DENOM_SOCIAL;DENOM_COMERC;SIT;MOTIVO_CANCEL;SIT_EMISSOR;DT_CANCEL;DT_CONST;SETOR_ATIV;MUN\n12.345.678/0001-95;AÇO SA;;CANCELADA;INCORPORAÇÃO;;2011-01-02;1990-05-06;METALURGIA;SÃO PAULO\n1;VIVA LTDA;Viva;ATIVO;;;;2001-01-01;COMÉRCIO;RIO\n".encode("latin-1"))
    got = {r["name"]: r for r in adapters.ADAPTERS["register"](spark, str(tmp_path / "r.csv")).collect()}
    a, b = got["AÇO SA"], got["Viva"]
    assert (a.cnpj, a.status, a.outcome, a.founded_year, a.shutdown_year) == ("12345678000195", "Inactive", "acquired", "1990", "2011")
    assert (b.cnpj, b.status, b.norm, b.categories) == (None, "Active", "viva", ["Comércio"])


def test_holdings(spark, tmp_path):
    (tmp_path / "h.csv").write_text("cnpj;razao_social;ano;setor_de_atividade;aberta_fechada\n;Old Name;2010;Steel;Aberta\n;old name;2012;Energy;\n")
    (r,) = adapters.ADAPTERS["holdings"](spark, str(tmp_path / "h.csv")).collect()
    assert r["name"] == "old name" and r.categories == ["Energy", "Steel"] and r.description == "Empresa brasileira com participação acionária da BNDESPar. Ativa no portfólio de 2010 a 2012. Setor(es): Energy, Steel. Tipo: companhia fechada."


def test_accelerator_and_ranking_and_sitemap(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"name":"Foo","one_liner":"does","long_description":"","batch":"W21","status":"Active","team_size":5,"all_locations":"Paris, France","website":"foo.io","industries":["B2B"],"tags":["AI"],"industry":"b2b","subindustry":"B2B -> Ops"}\n{"id":1,"name":"Foo","batch":"W21"}\n')
    (r,) = adapters.ADAPTERS["accelerator"](spark, str(tmp_path / "a.json")).where("website is not null").collect()
    assert (r.founded_year, r.country, r.city, r.categories) == ("2021", "France", "Paris", ["B2B", "AI", "Ops"])
    (tmp_path / "k.js").write_text("var data = [{rank: 1, name: 'Bar', location: 'Rio/RJ', category: 'Health', points: 10,}, {rank: 3, name: 'Bar', category: 'Edu'},];")
    (r,) = adapters.ADAPTERS["ranking"](spark, str(tmp_path / "k.js")).collect()
    assert (r["name"], r.city, r.categories) == ("Bar", "Rio", ["Edu", "Health"])
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x.org/company/foo</loc></url><url><loc>https://x.org/</loc></url></urlset>")
    assert {x.url: x.kind for x in adapters.sitemap(spark, str(tmp_path / "s.xml")).collect()} == {"https://x.org/company/foo": "company", "https://x.org/": "page"}


def test_knowledge_graph_and_corpus_merge(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"co":"http://w/Q1","coLabel":"Foo","founded":"1999-01-01","closed":null,"country":"BR","industries":"steel | iron","founders":"Ann","website":null}\n{"co":"http://w/Q1","coLabel":"Foo","closed":"2005-02-02"}\n{"co":"http://w/Q2","coLabel":"Q2"}\n')
    (r,) = adapters.ADAPTERS["knowledge_graph"](spark, str(tmp_path / "w.json")).collect()
    assert (r.status, r.shutdown_year, r.categories, r.links) == ("Inactive", "2005", ["steel", "iron"], ["https://www.wikidata.org/wiki/Q1"])
    (tmp_path / "c.json").write_text('[{"name": "FOO Inc", "country": "Brazil", "categories": ["metal"]}, {"name": " "}]')
    rows = adapters.all_sources(spark, {"corpus": str(tmp_path / "c.json"), "knowledge_graph": str(tmp_path / "w.json")})
    (m,) = linkage.merge_records(rows, ["name", "country", "status"], ["categories"]).collect()
    assert (m.norm, m["name"], m.country, m.status, m.categories, m.sources) == ("foo", "FOO Inc", "Brazil", "Inactive", ["metal", "steel", "iron"], ["corpus", "knowledge_graph"])
    assert adapters.all_sources(spark, {}).count() == 0


def test_encyclopedia(spark):
    pages = spark.createDataFrame([("Foo (company)", "Foo was acquired by Bar.", "{{Infobox\n| founded = {{start}} 1987\n| industry = [[Steel]]\n| location = Lyon, France\n}}"), ("Bar", None, "")], "title string, extract string, wikitext string")
    (r,) = adapters.encyclopedia(pages).collect()
    assert (r["name"], r.status, r.founded_year, r.country, r.categories) == ("Foo", "Acquired", "1987", "France", ["Steel"])


PAGE = "<html lang='en'><body><h2>Foo &amp; co</h2><p>First.</p><p>Second</p><ul><li>Founded: 1999</li><li>plain</li></ul><h3>Sub</h3><table><tr><th>Company name</th><th>Year founded</th></tr><tr><td>Acme</td><td>2001</td></tr></table></body></html>"


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    got = html.sections(pages).orderBy("section").collect()
    assert [(r.heading, r.content, r["items"]) for r in got] == [("Foo & co", "First.\nSecond", ["Founded: 1999", "plain"]), ("Sub", "", [])]
    assert html.cards(pages).first().fields == {"founded": "1999"}
    (r,) = html.table_records(html.tables(pages), {"name": ["company", "name"], "year": ["year"]}).collect()
    assert (r["name"], r.year) == ("Acme", "2001")
    p = spark.createDataFrame([("Acme2019, Berlin, Seed",), ("Plain, x",)], "c string")
    assert [(r.p["name"], r.p["year"]) for r in p.select(html.packed_cell(p.c).alias("p")).collect()] == [("Acme", "2019"), ("Plain", "")]


def test_packed_cells_without_stage_or_place(spark):
    cells = ["Carvana2012,Phoenix(United States),Public", "Acme2019", "Acme2019, Berlin", "Two Words 2001,Sao Paulo, Brazil, Series A", "B12345,Oslo,1st", "Plain, Inc", "2019,Berlin", "Odd2019x,Here"]
    p = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [tuple(r.p) for r in p.select("i", html.packed_cell(p.c).alias("p")).orderBy("i").collect()]
    want = [("Carvana", "2012", "Phoenix(United States)", "Public"), ("Acme", "2019", "", ""), ("Acme", "2019", "Berlin", ""), ("Two Words", "2001", "Sao Paulo, Brazil", "Series A")]
    assert got == [*want, ("B1", "2345", "Oslo,1st", ""), ("Plain", "", "", ""), ("2019", "", "", ""), ("Odd2019x", "", "", "")]


def test_pages_of_customers_are_dealt_over_tasks(spark, tmp_path):
    from peerlens.plans import source_queries

    spark.range(400).selectExpr("id as c_custkey", "concat('C', id) as c_name", "'seg' as c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    held = source_queries._page(spark, str(tmp_path), "<h1>", "c_name", "</h1>").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(held) >= 8 and max(held) < 200 and sum(held) == 400


def test_listicles_are_the_joined_parts_of_pages_parsed_once(spark):
    row = "<tr><td>{0}</td><td>1</td><td>{0}!</td></tr>"
    several = "<h2>A</h2><p>x</p><ul><li>Founded: 1999</li><li>founded: 2</li><li>b</li></ul><h3>B &amp; c</h3><ul><li>Team: a: b</li></ul><table><tr><th>Year</th><th>n</th><th>Company <b>name</b></th></tr>" + row.format("Acme") + row.format("Foo") + "</table>"
    links = '<a href="/c/steel">Steel</a><a href="/c/steel">Steel</a><a class="x" href="/c/steel/more"> Other </a><a href="/c/iron?x">Iron</a>'
    odd = "<script>x<h2>no</h2></script><nav><h2>Menu</h2></nav><h2>D<ul><li>K: v<li>L: w</ul><table><tr><td>only</td></tr></table>"
    pages = spark.createDataFrame([(1, PAGE + links), (2, several + links), (3, None), (4, ""), (5, odd + links), (6, several), (7, links), (8, "<tr><th>Name</th></tr><tr></tr><tr><td>z" + odd + links)], "page_id long, html string")
    roles = {"who": ["company", "name"], "n": ["n"], "none": ["zzz"]}
    got = html.listicles(pages, roles, "/c/")
    parts = [html.cards(pages).select("page_id", F.explode("fields").alias("field", "value")), html.table_records(html.tables(pages), roles).drop("row"), html.taxonomy(pages, "/c/")]
    want = parts[0].join(parts[1], "page_id").join(parts[2], "page_id").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.page_id for r in got.collect()} >= {1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan and "Exchange" not in plan


def test_listicle_cards_joins_nothing(spark, tmp_path):
    from peerlens.plans import source_queries

    spark.range(30).selectExpr("id as c_custkey", "concat('C#', id, 'x') as c_name", "'seg' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    got = source_queries.listicle_cards(spark, str(tmp_path))
    assert sorted((r.page_id, r["name"], r.year, r.listed, r.slug) for r in got.collect()) == [(i, f"C#{i}x", str(1990 + i), "seg", "p") for i in range(30)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapIn") == 1 and "Join" not in plan


def test_plain_pages_are_outlined_as_by_the_parser(monkeypatch):
    rng = random.Random(3)
    tags = ["h1", "H2", "h3", "p", "li", "ul", "table", "tr", "td", "th", "nav", "footer", "b", "br", "x9"]
    plain = ["a", " b\n", "&amp;", "&am", "&#65", "&notit;", "x > y", '"', "/", "\u00e9\x00", *[f"<{t}>" for t in tags], *[f"</{t}>" for t in tags], '<a href="/c/x?a=1&amp;b" data-x="">', "<p class=\"it's\">"]
    odd = ["<", "< p>", "<br/>", "<p/>", "<p a=b>", "<p a='<h2>'>", '<p a="<h2>x">', '<p a="1"b="2">', "</p >", '</p a="b">', "<!-- <h2>c</h2> -->", "<!DOCTYPE html>", "<?x?>", "<![CDATA[x]]>", "<script>", "</script>", "<TITLE>", "<style a=\"b\">", "<1>", "<p\n>", "<my-tag>", "</>", "<p"]

    def parsed(page):
        parser = html._Outline()
        parser.feed(page)
        parser.close()
        parser._close()
        return parser.parts

    fed = []
    feed = html._Outline.feed
    for n in range(4000):
        page = "".join(rng.choice(odd if n % 2 and rng.random() < 0.1 else plain) for _ in range(rng.randrange(30)))
        want = parsed(page)
        with monkeypatch.context() as m:
            m.setattr(html._Outline, "feed", lambda self, text: (fed.append(n), feed(self, text)))
            assert html.outline(page) == want, page
    assert not [n for n in fed if n % 2 == 0] and len(fed) > 1000
