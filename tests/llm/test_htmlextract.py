import random

from peerlens.llm import htmlextract as h


def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{x}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li>News {i}</li></ul></nav>"
        f"<div class='site-ad'>Buy {i}</div>{body}<footer>&copy; x</footer></body></html>{extra}"
    )


def test_article_with_broken_markup():
    p = page(1, "<article><h1>Head &amp; tail</h1><p><b>Lead\n  line.<br><p>Two &#233;.</p><aside>side</aside><div class=comments><p>me first</p></div><form><p>mail</p></form></article>")
    assert h.extract(p, h.infer([p])) == "Head & tail\n\nLead line.\n\nTwo é."
    assert h.extract(p, None) == "Head & tail\n\nLead line.\n\nTwo é."


def test_wrapper_without_article():
    def body(i, n):
        return f"<div class=top>Daily paper</div><div class=c1><div class=x>{'<p>para %d words here and more</p>' % i * 1}" + "".join(f"<p>more text {i} {k}</p>" for k in range(n)) + "<div class=z9>Read also our rules</div></div></div>"

    pages = [page(i, body(i, 3 + i)) for i in range(6)]
    rule = h.infer(pages)
    assert h.extract(pages[2], rule).split("\n\n") == ["para 2 words here and more", *(f"more text 2 {k}" for k in range(5))]
    # a page of another shape falls back on its own wrapper
    assert "other words" in h.extract("<html><body><section><p>other words</p></section></body></html>", rule)


def test_wrapper_is_union_free():
    a = h.wrap(h.parse("<ul><li>1</li><li>2</li></ul><p>x</p>"))
    b = h.wrap(h.parse("<ul><li>3</li></ul><hr><p>y</p>"))
    w = h.align(a, b)
    assert [k["s"] for k in w["kids"]] == ["ul", "hr", "p"]
    assert w["kids"][0]["kids"][0]["rep"] and w["kids"][1]["opt"] and w["kids"][2]["kids"][0]["t"] is None


def test_table(spark):
    rows = [(1, "http://A.com/x", page(1, "<article><p>one</p></article>")), (1, "http://A.com/x", page(1, "<article><p>one</p></article>")), (2, None, "<p>two"), (3, "http://a.com/y", None), (4, "http://b.org", ""), (None, "zz", "plain &lt; text"), (5, "http://a.com/long", page(5, "<article>" + "<p>word</p>" * 20000 + "</article>"))]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars, r.text[:20]) for r in h.extract_pages(docs).collect()), key=str)
    assert got == sorted([(1, 3, "one"), (1, 3, "one"), (2, 3, "two"), (3, 0, ""), (4, 0, ""), (None, 12, "plain < text"), (5, 20000 * 6 - 2, "word\n\nword\n\nword\n\nwo")], key=str)
    assert h.extract_pages(docs.limit(0)).count() == 0


def _articles(own, n=12):
    return [page(i, f"<article><h1>head {i}</h1>{own.get(i, '')}<p>body {i} of it</p><div class=z9>Read also our rules</div></article>") for i in range(n)]


def test_classed_part_of_a_single_page_is_no_template():
    pages = _articles({3: "<p class=lead>Only here</p>", 5: "<blockquote class=quote>Said once</blockquote>"}, 8)
    rule = h.infer(pages)
    assert h.extract(pages[3], rule) == "head 3\n\nOnly here\n\nbody 3 of it"
    assert h.extract(pages[5], rule) == "head 5\n\nSaid once\n\nbody 5 of it"
    assert h.extract(pages[0], rule) == "head 0\n\nbody 0 of it"


def test_template_is_counted_over_all_pages(spark):
    # one page of 40 differs in its byline; whichever pages are sampled, the byline stays, the fixed part goes
    pages = _articles({i: f"<p class=by>By {'Bo' if i == 17 else 'Al'}</p>" for i in range(40)}, 40)
    docs = spark.createDataFrame([(i, f"http://a.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract_pages(docs).collect()}
    assert got == {i: f"head {i}\n\nBy {'Bo' if i == 17 else 'Al'}\n\nbody {i} of it" for i in range(40)}
    # copies of a page are one page
    docs = docs.limit(3).union(docs.limit(3)).union(docs.limit(3))
    assert all("Read also our rules" in r.text for r in h.extract_pages(docs).collect())


def _plain_host(n=12):
    """No article, no main, no telling class or tag: only what the host's pages have in common tells template from text."""
    return [
        f"<html><body><div class=a1><div class=b>Our house</div><div class=b>Things we sell</div></div><div class=a2><div class=k><h1>Story {i * 37}</h1><p>First words {i * 101} of a story that is long enough to be read.</p>"
        + "".join(f"<p>Then part {i}-{k} of it follows with more words of its own.</p>" for k in range(2 + i % 3))
        + "<p class=w3>All our stories are checked twice</p></div></div><div class=a3>Call us at any time</div></body></html>"
        for i in range(n)
    ]


def test_pages_without_telling_marks_need_the_wrapper(spark):
    pages = _plain_host()
    want = ["\n\n".join([f"Story {i * 37}", f"First words {i * 101} of a story that is long enough to be read.", *(f"Then part {i}-{k} of it follows with more words of its own." for k in range(2 + i % 3))]) for i in range(len(pages))]
    docs = spark.createDataFrame([(i, f"http://plain.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract_pages(docs).collect()}
    assert got == dict(enumerate(want))
    # without the host's wrapper the template stays
    assert all("checked twice" in h.extract(p, None) for p in pages) and h.extract(pages[0], None) != want[0]


def test_deep_markup_is_kept():
    p = "<html><body>" + "<div>" * 150 + "<p>deep words</p>" + "</div>" * 150 + "</body></html>"
    assert h.extract(p, h.infer([p])) == "deep words" == h.extract(p, None)
    two = [p.replace("deep", f"deep {i}") for i in range(5)]
    assert h.extract(two[3], h.infer(two)) == "deep 3 words"


def test_plain_pages_equal_brute_force():
    """Articles made of random blocks against a list of what was put in; boilerplate around them varies by page."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    pages, want = [], []
    for i in range(30):
        blocks = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        body = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}</b>", "<pre>{}</pre>"]).format(b.replace(" ", rng.choice([" ", "\n ", "&#32;"]))) for b in blocks)
        pages.append(page(i, f"<aside>{rng.choice(words)}</aside><article>{body}<div class=comments><p>{rng.choice(words)}</p></div></article>"))
        want.append("\n\n".join(blocks))
    rule = h.infer(pages[:8])
    assert [h.extract(p, rule) for p in pages] == want


def test_main_region_is_told_by_all_pages(spark):
    # few pages of a host look otherwise; whichever blocks they fall into, the region of most pages counts, and no page is left out
    usual = _plain_host(40)
    docs = spark.createDataFrame([(i, "http://plain.com/x", p) for i, p in enumerate(usual + usual[:20])], "page_id long, url string, html string")
    import pyspark.sql.functions as F

    told = h.host_mains(docs)
    assert [r.main for r in told.collect()] == [h.infer_main(usual)]
    again = docs.repartition(7, F.col("page_id"))
    assert told.collect() == h.host_mains(again).collect()
