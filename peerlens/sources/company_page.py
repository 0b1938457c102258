"""Companies from their pages and from tables of lists, read off node tables and grids.

Values come from meta tags, badges, links and labels in the text; sections from the order of headings, paragraphs and items. All of a page
comes from one parse of it and one grouping by page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx

from . import dom, html

NAME = r"[A-Z][\p{L}'.-]+(?: [A-Z][\p{L}'.-]+){1,2}"


def behind(label: list[str], value: str, text: Column) -> Column:
    """The first group of a pattern that stands right behind one of some labels, with a colon, blank or line break between."""
    words = cl.any_of(label)
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?<![\p{{L}}])(?i:{words})[:\s]+{value}", 1)), F.lit(""))


def _first(test: Column, value: Column) -> Column:
    """Aggregate: the value of the first element that passes a test."""
    return F.min_by(value, F.when(test, F.col("node")))


def fields(elements: DataFrame, slugs: DataFrame, own_site: str = "") -> DataFrame:
    """One row for each page of slugs (page_id, slug): what meta tags, badges, links and labels tell of its company."""
    href, tag = dom.attribute("href"), F.element_at("path", -1)["tag"]
    meta = F.coalesce(dom.attribute("property"), dom.attribute("name"))
    link = dom.matches("a[href]")
    outward = link & href.startswith("http")
    for part in [*lx.NOT_A_WEBSITE, *([own_site] if own_site else [])]:
        outward = outward & ~href.contains(part)
    made = elements.groupBy("page_id").agg(
        _first(F.col("parent").isNull(), F.col("text")).alias("_text"),
        *[_first((tag == "meta") & (meta == m), dom.attribute("content")).alias(f"_{m.split(':')[-1]}{'_og' if ':' in m else ''}") for m in ("og:title", "og:description", "description", "og:image")],
        _first(tag == "title", F.col("text")).alias("_heading"),
        *[F.max(F.lower("own") == s.lower()).alias(f"_is_{i}") for i, s in enumerate(lx.PAGE_STATUSES)],
        F.array_sort(F.collect_set(F.when(link & href.contains("/browse/category/"), F.struct("node", F.col("text").alias("v"))))).alias("_categories"),
        F.array_sort(F.collect_set(F.when(link & href.contains("/company/"), F.struct("node", F.regexp_replace(F.substring_index(href, "/company/", -1), "^/+|/+$", "").alias("v"))))).alias("_related"),
        _first(outward, href).alias("website"),
        _first(link & href.contains("ycombinator.com/companies"), href).alias("yc_url"),
    )
    rows = slugs.join(made, "page_id", "left")
    text = F.coalesce("_text", F.lit(""))
    title = F.coalesce("_title_og", F.lit(""))
    named = F.coalesce(tx.absent(F.regexp_replace(title, r"\s*[-|–].*$", "")), tx.absent(F.regexp_replace(F.coalesce("_heading", F.lit("")), r"\s*[-|–].*$", "")), F.lit(""))
    badge = F.coalesce(*[F.when(F.col(f"_is_{i}"), s) for i, s in enumerate(lx.PAGE_STATUSES)], *[F.when(F.left(text, F.lit(2000)).rlike(rf"(?i)\b{s}\b"), s) for s in lx.PAGE_STATUSES[:4]])
    batch = F.coalesce(F.nullif(F.regexp_extract(title, r"\(([^)]*\d{4}[^)]*)\)", 1), F.lit("")), F.nullif(F.regexp_extract(F.left(text, F.lit(2000)), rf"({cl.any_of(list(lx.BATCH_SEASONS.values()))} \d{{4}}|\b[WSF]\d{{2}}\b)", 1), F.lit("")))
    seasons = F.create_map(*[F.lit(x) for kv in lx.BATCH_SEASONS.items() for x in kv])
    season = F.coalesce(F.nullif(F.regexp_extract("yc_batch", rf"({cl.any_of(list(lx.BATCH_SEASONS.values()))})", 1), F.lit("")), F.element_at(seasons, F.regexp_extract("yc_batch", r"^([WSF])\d{2}$", 1)))
    values = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: x["v"]), lambda v: v != ""))
    near = F.left(text, F.lit(3000))
    return rows.select(
        "page_id", "slug", named.alias("name"), F.coalesce("_description_og", "_description", F.lit("")).alias("one_liner"), F.coalesce("_image_og", F.lit("")).alias("logo_url"),
        F.coalesce(badge, F.lit("")).alias("status"), F.coalesce(batch, F.lit("")).alias("yc_batch"),
        F.coalesce(values(F.col("_categories")), F.array().cast("array<string>")).alias("categories"), "website", "yc_url",
        behind(lx.PLACE_LABELS, r"([A-Z][^\n]*)", near).alias("location"),
        behind(["founded in", "founded"], r"(\d{4})", near).alias("founded_year"),
        behind(["team size"], r"(\d[\d,]*)", near).alias("team_size"),
        behind(["total funding", "total raised"], r"\$?([\d.,]+ ?[MBK]?)", text).alias("total_funding"),
        F.array_distinct(F.regexp_extract_all(F.coalesce(behind(["founders", "founder"], rf"((?:{NAME}(?:,?\s+|$))+)", F.concat(near, F.lit("\n"))), F.lit("")), F.lit(f"({NAME})"), F.lit(1))).alias("founders"),
        F.rtrim(behind(["acquired by", "acquirer"], r"([A-Z][^\n,;:()]*)", text), F.lit(" .")).alias("acquirer"),
        F.left(text, F.lit(5000)).rlike(f"(?i){cl.any_of(lx.LOCKED_MARKERS)}").alias("report_locked"),
        F.filter(F.coalesce(values(F.col("_related")), F.array().cast("array<string>")), lambda v: ~F.contains(v, F.col("slug"))).alias("related"),
    ).withColumns({"yc_batch_season": F.coalesce(season, F.lit("")), "yc_batch_year": F.coalesce(cl.batch_year(F.col("yc_batch")).cast("string"), F.lit(""))})


def sections(elements: DataFrame) -> DataFrame:
    """page_id, section (node of its h1 or h2), part (node of its heading), level, heading, content, items: what follows each heading up to the next.

    Paragraphs of a part are lines of its content. Items and paragraphs within other paragraphs or items count once, with the outer one.
    """
    tag = F.element_at("path", -1)["tag"]
    level = F.when(tag.rlike("^h[1-4]$"), F.substring(tag, 2, 1).cast("int"))
    outer = ~F.exists(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda s: s["tag"].isin("p", "li", "nav", "footer"))
    rows = elements.select("page_id", "node", "text", tag.alias("tag"), level.alias("level"), outer.alias("outer")).where(F.col("level").isNotNull() | (F.col("tag").isin("p", "li") & F.col("outer")))
    w = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)  # a page
    placed = rows.withColumns({"section": F.last(F.when(F.col("level") <= 2, F.col("node")), True).over(w), "part": F.last(F.when(F.col("level").isNotNull(), F.col("node")), True).over(w)})
    listed = lambda tag: F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == tag) & (F.col("text") != ""), F.struct("node", "text")))), lambda x: x["text"])
    made = placed.where("part is not null").groupBy("page_id", F.coalesce("section", "part").alias("section"), "part").agg(F.max("level").alias("level"), F.max_by("text", "level").alias("heading"), F.array_join(listed("p"), "\n").alias("content"), listed("li").alias("items"))
    return made.where("heading <> ''")


def report(parts: DataFrame) -> DataFrame:
    """page_id, one struct (content, items) for each known section, sources, build_plan (its heading), report_available.

    A section holds its own part and those of deeper headings. Of several headings with one name the last counts, of build plans the first.
    """
    known = F.create_map(*[F.lit(x) for name, heads in lx.PAGE_SECTIONS.items() for h in heads for x in (h, name)])
    whole = parts.groupBy("page_id", "section").agg(
        F.min_by("heading", "part").alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "\n").alias("content"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "items"))), lambda x: x["items"])).alias("items"),
    )
    key = F.lower(F.trim("heading"))
    rows = whole.withColumns({"kind": F.element_at(known, key), "plan": key.rlike(cl.any_of(lx.BUILD_PLAN_WORDS))})
    value = F.struct(F.regexp_replace(F.regexp_replace("content", "\n{2,}", "\n"), "^\n|\n$", "").alias("content"), "items")
    made = rows.groupBy("page_id").agg(*[F.max_by(F.when(F.col("kind") == k, value), F.when(F.col("kind") == k, F.col("section"))).alias(k) for k in lx.PAGE_SECTIONS], F.min_by("heading", F.when(F.col("plan"), F.col("section"))).alias("build_plan"), F.count("*").alias("_n"))
    lines = F.filter(F.concat(F.col("sources.items"), F.split("sources.content", "\n")), lambda x: x != "")
    told = F.coalesce(*[F.col(k) for k in ("overview", "founding_story", "post_mortem", "what_they_built")]).isNotNull() | (F.col("_n") > 1)
    return made.withColumns({"sources": F.coalesce(lines, F.array().cast("array<string>")), "report_available": told}).drop("_n")


def companies(pages: DataFrame, own_site: str = "") -> DataFrame:
    """Companies of pages (page_id, url, html): fields(), sections, and competitors named in the market position and the post-mortem."""
    elements = dom.nodes(pages)
    slugs = pages.select("page_id", F.regexp_extract("url", r"/company/([^/?#]+)", 1).alias("slug"))
    rows = fields(elements, slugs, own_site).join(report(sections(elements)), "page_id", "left")
    rival = F.concat_ws(" ", "market_position.content", "post_mortem.content", F.array_join("market_position.items", " "))
    return rows.withColumns({"competitors": tx.competitor_names(rival), "report_available": F.coalesce("report_available", F.lit(False))})


def listicle(elements: DataFrame) -> DataFrame:
    """page_id, card, list_label, name, description, founders, country, categories, years, headcount, funding, cause, deep_link, status of the cards of lists of failed companies.

    A card is an element of its own class with a heading; its first paragraph describes it, its items hold a label and a value each.
    """
    rows = elements.withColumns({"card": dom.within(".listicle-startup-collection-item"), "item": dom.within("li.listicle-list-item")})
    title = rows.groupBy("page_id").agg(F.coalesce(_first(dom.matches("h1"), F.col("text")), F.lit("")).alias("list_label"))
    inside = rows.where("card is not null")
    href = dom.attribute("href")
    deep = dom.matches("a[href]") & (href.contains("/cemetery/") | ~href.contains("/startups/"))
    heads = inside.groupBy("page_id", "card").agg(_first(dom.matches(".listicle-h3"), F.col("text")).alias("name"), _first(dom.matches("p.content-paragraph"), F.col("text")).alias("description"), _first(deep, href).alias("deep_link"))
    items = inside.where("item is not null").groupBy("page_id", "card", "item").agg(_first(dom.matches(".listicle-list-category"), F.col("text")).alias("k"), _first(dom.matches(".failed-startup-list-information"), F.col("text")).alias("v"))
    key = F.lower(F.regexp_replace("k", ":+$", ""))
    told = items.where("k is not null and v is not null").groupBy("page_id", "card", key.alias("k")).agg(F.max_by("v", "item").alias("v")).groupBy("page_id", "card").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("f"))  # labels of a card
    get = lambda *names: F.coalesce(*[F.element_at("f", F.lit(n)) for n in names], F.lit(""))
    made = heads.where("name is not null").join(told, ["page_id", "card"], "left").join(title, "page_id")
    founders = F.filter(F.transform(F.split(get("founders"), ",|&| and "), lambda x: F.trim(x)), lambda x: x != "")
    return made.select(
        "page_id", "card", "list_label", "name", F.coalesce("description", F.lit("")).alias("description"), founders.alias("founders"), get("country").alias("country"), F.filter(F.array(get("industry")), lambda x: x != "").alias("categories"),
        get("started in").alias("founded_year"), get("closed in").alias("shutdown_year"), get("nº of employees", "n° of employees", "no of employees").alias("headcount"), get("funding amount").alias("total_funding"),
        get("specific cause of failure").alias("failure_cause"), F.coalesce("deep_link", F.lit("")).alias("deep_link"), F.lit("Inactive").alias("status"),
    )


#: Roles of columns by words of their header, in order of precedence: exact names, words within, words that must not stand beside.
ROLES = [
    ("name", ["company", "startup"], ["company details", "company name"], []),
    ("description", [], ["description"], []),
    ("funding", [], ["funding"], ["round", "date"]),
    ("investors", [], ["investor"], []),
    ("founded", [], ["founded"], []),
    ("location", [], ["location", "hq"], []),
    ("stage", [], ["stage"], []),
]


def table_companies(cells: DataFrame) -> DataFrame:
    """row_companies() of dom.grids() cells, which are grouped by table first."""
    key = ["page_id", "grid"]
    heads = cells.where("header").groupBy(*key, "text").agg(F.min("col").alias("col")).groupBy(*key).agg(F.collect_list(F.struct("col", "text")).alias("heads"))
    at = lambda what: F.map_from_entries(F.collect_list(F.struct("col", what)))
    rows = cells.where("not header").groupBy(*key, "row").agg(at("text").alias("texts"), at("links").alias("links"))
    return row_companies(rows.join(heads, key).select(*key, "heads", F.array(F.struct("row", "texts", "links")).alias("rows")))


def row_companies(tables: DataFrame) -> DataFrame:
    """page_id, grid, row, name, description, founded_year, location, status, total_funding, investors, profile_url of dom.grid_rows() that list companies.

    A header has the first role it fits; a role goes to its leftmost column. Tables without a name column and those of rounds or listings are left out. What is packed
    into the name (year, place, stage) gives way to columns of its own; a stage is a status only if it is a known one.
    """
    key = ["page_id", "grid"]

    def role(h: Column) -> Column:
        head = F.lower(F.trim(h["text"]))
        return F.coalesce(*[F.when((head.isin(exact) if exact else F.lit(False)) | (F.greatest(*[F.contains(head, F.lit(w)) for w in within], F.lit(False)) & ~F.greatest(*[F.contains(head, F.lit(w)) for w in without], F.lit(False), F.lit(False))), name) for name, exact, within, without in ROLES])

    def other(h: Column) -> Column:
        head = F.lower(F.trim(h["text"]))
        return (F.contains(head, F.lit("round")) & F.contains(head, F.lit("raised"))) | F.contains(head, F.lit("ipo date"))

    heads = tables.where(~F.exists("heads", other)).withColumn("_heads", F.transform("heads", lambda h: F.struct(h["col"].alias("col"), role(h).alias("role"))))
    # once for each record of many rows, whose tables needn't be put together again
    placed = heads.select(*key, "rows", *[F.array_min(F.transform(F.filter("_heads", lambda h: h["role"] == name), lambda h: h["col"])).alias(f"_{name}") for name, *_ in ROLES]).where("_name is not null")
    at = lambda name, what="texts": F.try_element_at(f"r.{what}", F.col(f"_{name}"))
    made = placed.select(*key, *[f"_{name}" for name, *_ in ROLES], F.explode("rows").alias("r")).select(*key, "r.row", *[at(name).alias(name) for name, *_ in ROLES], at("name", "links").alias("_links"))
    made = made.where((F.coalesce("name", F.lit("")) != "") & (F.length("name") <= 400))
    packed = html.packed_cell(F.col("name"))
    is_packed = F.col("name").rlike(r"\d{4}") & F.contains("name", F.lit(","))
    made = made.withColumns({"_packed": packed, "_is": is_packed})
    stage = F.coalesce(tx.absent(F.col("stage")), F.when(F.col("_is"), F.col("_packed.stage")), F.lit(""))
    backers = F.transform(F.split(F.regexp_replace(F.coalesce("investors", F.lit("")), r"(?i)&\s*\d+\s*others?", ""), ",|&"), lambda x: F.trim(x))
    fields = F.struct(
        F.when(F.col("_is"), F.col("_packed.name")).otherwise(F.regexp_replace("name", "^[, ]+|[, ]+$", "")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.when(F.col("founded").rlike(r"^\d{4}$"), F.col("founded")).otherwise(F.when(F.col("_is"), F.col("_packed.year")).otherwise("")).alias("founded_year"),
        F.coalesce(tx.absent(F.col("location")), F.when(F.col("_is"), F.col("_packed.location")), F.lit("")).alias("location"),
        F.when(stage.isin(lx.LISTED_STAGES), stage).otherwise("").alias("status"),
        F.coalesce("funding", F.lit("")).alias("total_funding"),
        F.filter(backers, lambda x: (x != "") & (F.length(x) < 80)).alias("investors"),
        F.coalesce(F.get(F.filter("_links", lambda x: F.contains(x, F.lit("/d/companies/"))), F.lit(0)), F.lit("")).alias("profile_url"),
    )
    # a generator: filters of its columns stay above it and don't compute them once more
    out = made.select(*key, "row", F.inline(F.array(fields)))
    return out.where((F.col("name") != "") & (F.length("name") <= 120))
