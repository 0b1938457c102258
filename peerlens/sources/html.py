"""Records from stored web pages: links, profiles, cards, tables and section trees. Fetching is left to crawlers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx


def links(pages: DataFrame, html: str = "html", pattern: str | None = None) -> DataFrame:
    """page_id, link: targets of anchors in page order, those that match a pattern if one is given."""
    found = F.regexp_extract_all(F.col(html), F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", F.explode(found).alias("link"))
    return rows.where(F.col("link").rlike(pattern)) if pattern else rows


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by name or property."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]+(?:name|property)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def profile(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


def packed_cell(c: Column) -> Column:
    """struct<name, year, location, stage> of a cell such as `Acme2019,Berlin(Germany),Seed`; location and stage may be absent.

    The name ends at the first four digits that close the cell or stand before a comma. Of the parts behind, the last is the stage if there
    are several and it begins with a letter; all others are the location. A cell of another form gives its first part as the name.
    """

    def named(whole: Column) -> Column:
        # of what ends with the year: a lambda's argument is computed once, whatever is read off it
        text = F.rtrim(whole, F.lit(" \t\n\x0b\f\r"))
        behind = F.substr(c, F.length(whole) + 1)
        behind = F.when(F.startswith(behind, F.lit(",")), F.substr(behind, F.lit(2))).otherwise(behind)
        return F.struct(whole.alias("whole"), F.trim(F.left(text, F.length(text) - 4), F.lit(", ")).alias("name"), F.right(text, F.lit(4)).alias("year"), behind.alias("behind"), F.substring_index(behind, ",", -1).alias("end"))

    def told(p: Column) -> Column:
        last = F.trim(p["end"])
        first = F.left(last, F.lit(1))
        staged = F.contains(p["behind"], F.lit(",")) & (first.between("A", "Z") | first.between("a", "z"))
        place = F.trim(F.when(staged, F.left(p["behind"], F.length(p["behind"]) - F.length(p["end"]) - 1)).otherwise(p["behind"]))
        parsed = F.struct(p["name"].alias("name"), p["year"].alias("year"), place.alias("location"), F.when(staged, last).otherwise("").alias("stage"))
        plain = F.struct(F.trim(F.split(c, ",")[0]).alias("name"), F.lit("").alias("year"), F.lit("").alias("location"), F.lit("").alias("stage"))
        return F.when(p["whole"] != "", parsed).otherwise(plain)

    year = F.regexp_extract(c, r"^.+?\d{4}\s*(?=,|$)", 0)
    return F.get(F.transform(F.transform(F.array(year), named), told), F.lit(0))


class _Outline(HTMLParser):
    """Headings, paragraphs, list items and table rows of a page, in order."""

    SKIP = {"script", "style", "nav", "footer"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, list[str]]] = []
        self.kind: str | None = None
        self.buffer: list[str] = []
        self.cells: list[str] = []
        self.hidden = 0

    def _close(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if self.kind in ("td", "th"):
            self.cells.append(text)
        elif self.kind and text:
            self.parts.append((self.kind, [text]))
        self.kind = None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self._close()
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "p", "li", "td", "th"):
            self._close()
            self.kind = tag
        elif tag == "tr":
            self._close()
            self.cells = []

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "tr":
            self._close()
            if self.cells:
                self.parts.append(("tr", self.cells))
            self.cells = []
        elif tag == self.kind:
            self._close()

    def handle_data(self, data):
        if not self.hidden and self.kind:
            self.buffer.append(data)


#: Start tags with quoted attributes only, and end tags without any.
_TAG = re.compile(r'<(/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?: [a-zA-Z][a-zA-Z-]*="[^"<>]*")*)>')
#: Elements whose content may not be markup.
_RAW = re.compile("<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)", re.I)


def outline(page: str | None) -> list[tuple[str, list[str]]]:
    """Parts of a page; where it is nothing but plain tags and texts, one split gives what the parser would, at a fraction of its time."""
    parser = _Outline()
    pieces = _TAG.split(page or "")
    if _RAW.search(page or "") or any("<" in text for text in pieces[::2]):
        parser.feed(page or "")
        parser.close()
    else:
        for text, tag in zip(pieces[::2], [*pieces[1::2], ""], strict=True):
            if text:
                parser.handle_data(unescape(text))
            if tag.startswith("/"):
                parser.handle_endtag(tag[1:].lower())
            elif tag:
                parser.handle_starttag(tag.split(" ", 1)[0].lower(), None)
    parser._close()
    return parser.parts


SECTIONS = "page_id long, section int, heading string, content string, items array<string>"


def _sections_of(parts: list[tuple[str, list[str]]]) -> list[dict]:
    """Headings of an outline with the paragraphs and list items up to the next."""
    made: list[dict] = []
    for kind, texts in parts:
        if kind[0] == "h":
            made.append({"heading": texts[0], "content": [], "items": []})
        elif made and kind == "p":
            made[-1]["content"].append(texts[0])
        elif made and kind == "li":
            made[-1]["items"].append(texts[0])
    return [{**m, "content": "\n".join(m["content"])} for m in made]


def _rows_of(parts: list[tuple[str, list[str]]]) -> list[list[str]]:
    """Cells of the table rows of an outline."""
    return [texts for kind, texts in parts if kind == "tr"]


def sections(pages: DataFrame) -> DataFrame:
    """One row for each heading: the paragraphs and list items up to the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"page_id": page_id, "section": i, **m} for page_id, page in zip(frame["page_id"], frame["html"], strict=True) for i, m in enumerate(_sections_of(outline(page)))]
            yield pd.DataFrame(rows, columns=["page_id", "section", "heading", "content", "items"])

    return pages.select("page_id", "html").mapInPandas(run, SECTIONS)


#: What outlined() adds, and the same for Arrow.
OUTLINED = "sections array<struct<heading:string,content:string,items:array<string>>>, rows array<array<string>>"
_OUTLINED = pa.schema([("sections", pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string()), ("items", pa.list_(pa.string()))]))), ("rows", pa.list_(pa.list_(pa.string())))])


def outlined(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with `sections` (heading, content and items of each, as of sections()) and `rows` (cells of each, as of tables()) in place of their html: one parse for both."""
    rest = pages.drop(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outline(page.as_py()) for page in batch.column(0)]
            made = [[_sections_of(parts) for parts in found], [_rows_of(parts) for parts in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(m, f.type) for m, f in zip(made, _OUTLINED, strict=True)]], [*batch.schema.names[1:], *_OUTLINED.names])

    return pages.select(html, *rest.columns).mapInArrow(run, StructType([*rest.schema, *StructType.fromDDL(OUTLINED)]))


CARDS = "page_id long, name string, description string, fields map<string,string>"


def card_fields(items: Column) -> Column:
    """Map of the `key: value` items of a card, the first of each key."""
    pairs = F.filter(items, lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda k: k["key"]), e["key"]) == i + 1)
    return F.map_from_entries(firsts)


def cards(pages: DataFrame) -> DataFrame:
    """Cards of a listicle: a heading, its first paragraph, and `key: value` items."""
    return sections(pages).select("page_id", F.col("heading").alias("name"), F.split("content", "\n")[0].alias("description"), card_fields(F.col("items")).alias("fields"))


def tables(pages: DataFrame) -> DataFrame:
    """page_id, row, cells of all table rows; headers come as they stand."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, page in zip(frame["page_id"], frame["html"], strict=True):
                rows += [{"page_id": page_id, "row": i, "cells": c} for i, c in enumerate(_rows_of(outline(page)))]
            yield pd.DataFrame(rows, columns=["page_id", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row int, cells array<string>")


def cell_of(header: Column, cells: Column, words: list[str]) -> Column:
    """The cell in the column of the first header that contains one of the words."""
    hit = F.array_position(F.transform(header, lambda h: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(h), w))), True)
    return F.when(hit > 0, F.get(cells, (hit - 1).cast("int")))


def table_records(rows: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Records of tables(): the column of a role is the first header that contains one of its words."""
    header = rows.where("row = 0").select("page_id", F.col("cells").alias("header"))
    body = rows.where("row > 0").join(header, "page_id")
    return body.select("page_id", "row", *[cell_of(F.col("header"), F.col("cells"), words).alias(role) for role, words in roles.items()])


def listicles(pages: DataFrame, roles: dict[str, list[str]], prefix: str) -> DataFrame:
    """page_id, field, value, a column a role, slug, name: each field of the cards() of a page with each of its table_records() and links of its taxonomy().

    A page is one row until all its parts are found, so it is parsed once, and nothing is joined or shuffled.
    """
    found = outlined(pages.select("page_id", "html", F.array_distinct(links_below(F.col("html"), prefix)).alias("links")))
    card = found.withColumn("_s", F.explode("sections")).select("page_id", "rows", "links", F.explode(card_fields(F.col("_s.items"))).alias("field", "value"))
    body = card.withColumns({"header": F.get("rows", 0), "cells": F.explode(F.filter("rows", lambda r, i: i > 0))})
    record = body.select("page_id", "field", "value", *[cell_of(F.col("header"), F.col("cells"), words).alias(role) for role, words in roles.items()], F.explode("links").alias("_l"))
    return record.select("*", "_l.slug", "_l.name").drop("_l")


def portfolio(pages: DataFrame, stop: list[str]) -> DataFrame:
    """page_id, name, url of outward links whose text is no navigation word; a link without text is named by its address."""
    anchors = F.regexp_extract_all("html", F.lit(r'<a[^>]+href="https?://[^"]+"[^>]*>[^<]*</a>'), F.lit(0))
    rows = pages.select("page_id", F.explode(anchors).alias("a"))
    url, text = F.regexp_extract("a", 'href="([^"]+)"', 1), F.trim(F.regexp_extract("a", ">([^<]*)</a>", 1))
    named = F.coalesce(F.nullif(text, F.lit("")), F.regexp_extract(url, r"^https?://(?:www\.)?([^./]+)", 1))
    return rows.select("page_id", named.alias("name"), url.alias("url")).where(~F.lower("name").isin(stop) if stop else F.lit(True)).dropDuplicates(["page_id", "url"])


def links_below(html: Column, prefix: str) -> Column:
    """array<struct<slug, name>> of the links below a path."""
    anchors = F.regexp_extract_all(html, F.lit(rf'<a[^>]+href="{prefix}[^"]+"[^>]*>[^<]*</a>'), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, rf'href="{prefix}([^"/?#]+)', 1).alias("slug"), F.trim(F.regexp_extract(a, ">([^<]*)</a>", 1)).alias("name")))


def taxonomy(pages: DataFrame, prefix: str) -> DataFrame:
    """page_id, slug, name of the links below a path."""
    return pages.select("page_id", F.inline(links_below(F.col("html"), prefix))).distinct()


def expanded(templates: DataFrame, first: int, last: int) -> DataFrame:
    """Templates with each year of a range for {year}."""
    return templates.select(F.col("template"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")).select("year", F.replace("template", F.lit("{year}"), F.col("year").cast("string")).alias("name"))


class _Interview(HTMLParser):
    """Name, label and value cells, and candidate bodies of an interview page."""

    LABEL, VALUE = "cemetery-page-data-category", "cemetery-page-data-information"
    BODIES = ("content-black-rich-text", "div-block-cemetery-article", "w-richtext")
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list]] = []
        self.found: list[tuple[str, list[str]]] = []  # kind and texts, in page order

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        names = (dict(attrs).get("class") or "").split()
        kind = next((n for n in (self.LABEL, self.VALUE, *self.BODIES) if n in names), tag if tag in ("h1", "h2", "h3", "p") else "")
        texts: list = []
        if kind:
            self.found.append((kind, texts))
        self.open.append((tag, texts if kind else None))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        text = " ".join(data.split())
        if text:
            for _, texts in self.open:
                if texts is not None:
                    texts.append(text)


def _interview(page: str | None) -> dict:
    parser = _Interview()
    parser.feed(page or "")
    parser.close()
    found = [(kind, " ".join(texts)) for kind, texts in parser.found]
    labels, values = ([t for kind, t in found if kind == want] for want in (parser.LABEL, parser.VALUE))
    meta: dict[str, str] = {}
    for label, value in zip(labels, values):
        key = lx.INTERVIEW_LABELS.get(label.rstrip(":").strip().lower())
        if key and value:
            meta.setdefault(key, value)
    # the body is the longest candidate of the first kind that stands on the page, else the page
    at = [i for kind in parser.BODIES for i in [j for j, (k, _) in enumerate(found) if k == kind]]
    first = next((found[i][0] for i in at), None)
    body = max((i for i in at if found[i][0] == first), key=lambda i: len(found[i][1]), default=None)
    end = len(found)
    inside = range(0 if body is None else body + 1, end)
    parts, left = [], None if body is None else found[body][1]
    for i in inside:
        kind, text = found[i]
        if left is not None and text not in left:
            break
        if kind in ("p", "h2", "h3") and len(text) >= 3 and not any(b in text.lower() for b in lx.INTERVIEW_BOILERPLATE):
            parts.append(text)
    name = next((t for kind, t in found if kind == "h1"), "")
    return {"name": name, "one_liner": next((p for p in parts if 40 <= len(p) <= 280), ""), "narrative": "\n\n".join(parts), "meta": meta}


def interviews(pages: DataFrame) -> DataFrame:
    """page_id, name, one_liner, narrative and meta of interview pages; a page without a heading is named by its address."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, page in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                r = _interview(page)
                r["name"] = r["name"] or (url or "").rsplit("/", 1)[-1].replace("-", " ").title()
                rows.append({"page_id": page_id, **r, "meta": list(r["meta"].items())})
            yield pd.DataFrame(rows, columns=["page_id", "name", "one_liner", "narrative", "meta"])

    pairs = "page_id long, name string, one_liner string, narrative string, meta array<struct<key: string, value: string>>"
    return pages.select("page_id", "url", "html").mapInPandas(run, pairs).withColumn("meta", F.map_from_entries("meta"))


TREE = "page_id long, node int, parent int, level int, heading string, content string, items array<string>"


def tree_of(page: str | None) -> list[dict]:
    """Headings of a page in order; the parent is the last heading of a lower level before it, absent at the top."""
    made: list[dict] = []
    path: list[dict] = []
    for kind, texts in outline(page):
        if kind[0] == "h":
            level = int(kind[1])
            while path and path[-1]["level"] >= level:
                path.pop()
            made.append({"node": len(made), "parent": path[-1]["node"] if path else None, "level": level, "heading": texts[0], "content": [], "items": []})
            path.append(made[-1])
        elif made and kind in ("p", "li"):
            made[-1]["content" if kind == "p" else "items"].append(texts[0])
    return made


def section_tree(pages: DataFrame) -> DataFrame:
    """One row for each heading with its place in the tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"page_id": page_id, **m, "content": "\n".join(m["content"])} for page_id, page in zip(frame["page_id"], frame["html"], strict=True) for m in tree_of(page)]
            out = pd.DataFrame(rows, columns=["page_id", "node", "parent", "level", "heading", "content", "items"])
            out["parent"] = out["parent"].astype("Int32")
            yield out

    return pages.select("page_id", "html").mapInPandas(run, TREE)


def company_pages(pages: DataFrame) -> DataFrame:
    """page_id, slug, name, description, status, batch, founded_year, website, links, related, competitors of company pages.

    Meta tags give name and description, badges the status and the batch, the text the founding year and competitors.
    """
    html = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    slug = F.regexp_extract(F.col("url"), r"/company/([^/?#]+)", 1)
    outward = F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(https?://[^"]+)"'), F.lit(1)))
    badge = F.nullif(F.regexp_extract(html, r'(?i)<span[^>]+class="[^"]*(?:badge|status)[^"]*"[^>]*>\s*(active|inactive|acquired|public)\s*<', 1), F.lit(""))
    return pages.select(
        "page_id",
        slug.alias("slug"),
        F.coalesce(meta(html, "og:title"), F.nullif(F.trim(F.regexp_extract(html, "(?s)<h1[^>]*>([^<]*)</h1>", 1)), F.lit(""))).alias("name"),
        F.coalesce(meta(html, "description"), meta(html, "og:description")).alias("description"),
        F.initcap(badge).alias("status"),
        F.nullif(F.regexp_extract(plain, r"\b((?:Winter|Summer|Spring|Fall) (?:19|20)\d{2})\b", 1), F.lit("")).alias("batch"),
        F.nullif(F.regexp_extract(plain, r"(?i)founded(?: in)?:?\s+((?:19|20)\d{2})", 1), F.lit("")).alias("founded_year"),
        F.get(F.filter(outward, lambda u: ~F.contains(u, F.lit("/company/"))), 0).alias("website"),
        outward.alias("links"),
        tx.related_slugs(html, F.when(slug != "", slug).otherwise("\u0000")).alias("related"),
        tx.competitor_names(plain).alias("competitors"),
    )
