"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page is a nested token stream of tags and text. For each host a wrapper starts as the stream of one page
and is aligned with further pages in turn. At a mismatch
* two texts in one place become a text slot,
* a run of siblings with one signature (tag and classes) becomes a repeated group, its members aligned with each other,
* what only one side has becomes an optional part.
The result has no unions. Its slots tell where the pages of a host differ: the main region is `article` or
`main` if there is one, else the part that holds most slot text outside boilerplate; parts whose text is
fixed on every page of the region are template and are left out (below). Boilerplate by tag, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) is left out everywhere.

The main region is inferred from all pages of a host, dealt by hash to blocks of about BLOCK pages: each block is aligned and tells
a region, and the region that most pages tell counts. What is template is counted over all pages of the host, combined in tasks: a classed path in the
region is template if all pages that hold it hold the same texts there and at least FIXED_PAGES of them are different
pages (copies count once). A text that differs on a single page is kept on all. A page that its host's wrapper doesn't fit, or whose host is
unknown, is read with a wrapper of its own. Wrappers are broadcast only up to BROADCAST_BYTES in all, else joined.

Defined results: null, empty or textless html gives an empty text; a null URL has the empty host; repeated rows each
get a result; broken markup is closed as browsers do (a new block ends an open paragraph).
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urlfilter import host_of

BLOCK = 8
FIXED_PAGES = 4  # a part is template only if that many different pages, and all that hold it, agree on it
BROADCAST_BYTES = 32 << 20
DEPTH = 60  # levels of markup that a wrapper tells apart
FLUSH = 100_000  # paths that a task counts before it passes them on

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|button)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_OUT_TAGS = set("head title nav header footer aside form menu dialog object label input".split())
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
_OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "body", "html"}


class Node:
    __slots__ = ("tag", "sig", "out", "kids")

    def __init__(self, tag: str, sig: str, out: bool):
        self.tag, self.sig, self.out, self.kids = tag, sig, out, []


def _opened(tag: str, attributes: str) -> Node:
    names: list[str] = []
    out = tag in _OUT_TAGS
    if attributes:
        for kind, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if kind.lower() == "role":
                out = out or value.strip() in _OUT_ROLES
            else:
                for name in value.split():
                    if kind.lower() == "class":
                        names.append(name)
                    out = out or any(x in _OUT_NAMES for x in re.split(r"[-_]+", name))
    return Node(tag, ".".join([tag, *names]), out and tag not in ("html", "body"))


def parse(page: str | None) -> Node:
    """The nested token stream of a page."""
    root = Node("", "", False)
    stack = [root]
    for m in _TOKEN.finditer(page or ""):
        text, tag = m[5], m[3]
        if text is not None:
            stack[-1].kids.append(text)
        elif tag:
            tag = tag.lower()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag == "p" and stack[k].tag in _HOLDERS:
                        break
                continue
            if tag == "br":
                stack[-1].kids.append("\n")
                continue
            if tag in _BLOCKS:
                closes = _CLOSES.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    open_ = stack[k].tag
                    if open_ == "p" or open_ in closes:
                        del stack[k:]
                        break
                    if open_ in _BLOCKS:
                        break
            node = _opened(tag, m[4])
            stack[-1].kids.append(node)
            if tag not in _VOID and not m[4].endswith("/"):
                stack.append(node)
    return root


def blocks(node: Node, skip: frozenset[str] = frozenset(), path: str = "") -> list[str]:
    """Texts of the blocks below a node in page order, without boilerplate and without template paths."""
    out: list[str] = []
    run: list[str] = []

    def close():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    stack: list[tuple] = [(node, path, False)]
    while stack:
        x, at, end = stack.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        block = x.tag in _BLOCKS
        if end:
            close()
            continue
        if x is not node and (x.out or at in skip):
            continue
        if block:
            close()
            stack.append((x, at, True))
        for kid in reversed(x.kids):
            stack.append((kid, at if isinstance(kid, str) else f"{at}/{kid.sig}", False))
    close()
    return out


# a wrapper: {"s": signature, "opt": optional, "rep": repeated, "out": boilerplate, "n": characters of slot text, "kids": [...]}; a text is {"t": fixed text or null for a slot, "n": characters}


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def wrap(node: Node, depth: int = 0) -> dict:
    """The wrapper of one page; runs of siblings with one signature are folded into repeated groups."""
    w: dict = {"s": node.sig, "out": node.out, "opt": False, "rep": False, "kids": []}
    if depth > DEPTH:  # below, a part is its text: nothing is lost but the places of slots in it
        text = " ".join(blocks(node))
        w["kids"] = [{"t": text, "n": len(text)}] if text else []
        return w
    kids: list[dict] = []
    for kid in node.kids:
        if isinstance(kid, str):
            text = _clean(kid)
            if text:
                kids.append({"t": text, "n": len(text)})
        else:
            kids.append(wrap(kid, depth + 1))
    for kid in kids:
        last = w["kids"][-1] if w["kids"] else None
        if last is not None and "t" in last and "t" in kid:
            w["kids"][-1] = {"t": None, "n": max(last["n"], kid["n"])}
        elif last is not None and "s" in last and last["s"] == kid.get("s"):
            w["kids"][-1] = {**align(last, kid), "rep": True}
        else:
            w["kids"].append(kid)
    return w


def align(a: dict, b: dict) -> dict:
    """The least wrapper that covers both: slots, repeated groups and optional parts at the mismatches."""
    if "t" in a:
        return {"t": a["t"] if a["t"] == b["t"] else None, "n": max(a["n"], b["n"])}
    x, y = a["kids"], b["kids"]
    keys_x, keys_y = [k.get("s", "#") for k in x], [k.get("s", "#") for k in y]
    if keys_x == keys_y:
        kids = [align(p, q) for p, q in zip(x, y, strict=True)]
    else:
        # longest common subsequence of signatures; streams were folded, so they are short
        n, m = len(x), len(y)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if keys_x[i] == keys_y[j] else max(best[i + 1][j], best[i][j + 1])
        kids, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and keys_x[i] == keys_y[j]:
                kids.append(align(x[i], y[j]))
                i, j = i + 1, j + 1
            elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
                kids.append({**x[i], "opt": True})
                i += 1
            else:
                kids.append({**y[j], "opt": True})
                j += 1
        folded: list[dict] = []
        for kid in kids:  # neighbours that became equal by the alignment
            if folded and "s" in kid and folded[-1].get("s") == kid["s"]:
                folded[-1] = {**align(folded[-1], kid), "rep": True}
            else:
                folded.append(kid)
        kids = folded
    return {"s": a["s"], "out": a["out"] or b["out"], "opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"], "kids": kids}


def _mass(w: dict, slots_only: bool) -> int:
    total, stack = 0, [w]
    while stack:
        x = stack.pop()
        if "t" in x:
            total += x["n"] if x["t"] is None or not slots_only else 0
        elif not x["out"]:
            stack.extend(x["kids"])
    return total


def region(w: dict, pages: int) -> str:
    """Path of the main region of a wrapper."""
    marked, stack = [], [(w, "")]
    while stack:
        x, at = stack.pop()
        for kid in x["kids"]:
            if "s" in kid and not kid["out"]:
                path = f"{at}/{kid['s']}"
                if re.split(r"[.]", kid["s"])[0] in ("article", "main"):
                    marked.append((_mass(kid, False), -len(path), path, kid))
                stack.append((kid, path))
    if marked:
        # of several marked parts the one with most slot text, where the host's pages tell slots from fixed text
        told = pages > 1 and any(_mass(m[3], True) for m in marked)
        _, _, path, node = max(marked, key=lambda m: (m[3]["s"].split(".")[0] == "article", _mass(m[3], True) if told else 0, m[0], m[1]))
    else:
        path, node = "", w
        slots = pages > 1 and _mass(w, True) > 0
        while True:
            down = [(k, _mass(k, slots)) for k in node["kids"] if "s" in k and not k["out"]]
            down = [(k, n) for k, n in down if n]
            if not down:
                break
            kid, n = max(down, key=lambda d: d[1])
            if n < 0.8 * _mass(node, slots) or kid["rep"] or kid["s"].split(".")[0] in ("p", "h1", "h2", "ul", "ol", "table", "b", "i", "a", "span"):
                break
            path, node = f"{path}/{kid['s']}", kid
    return path


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def parts(root: Node, main: str) -> tuple[int, dict[str, int]]:
    """The mark of a page's text outside boilerplate, and for the main region and each classed path in it the mark of the texts there."""
    inside = main + "/"
    found: dict[str, set[int]] = {}
    # a node's mark is a polynomial over its texts in order, so that a parent's mark comes from those of its children
    marks: list[list[int]] = [[0, 1]]
    stack: list[tuple] = [(root, "", False)]
    while stack:
        x, at, end = stack.pop()
        if isinstance(x, str):
            text = _clean(x)
            if text:
                mark = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                marks[-1][0] = (marks[-1][0] * _BASE + mark + 1) % _PRIME
                marks[-1][1] = marks[-1][1] * _BASE % _PRIME
        elif end:
            mark, power = marks.pop()
            marks[-1][0] = (marks[-1][0] * power + mark) % _PRIME
            marks[-1][1] = marks[-1][1] * power % _PRIME
            if mark and (at == main or at.startswith(inside) and "." in x.sig):
                found.setdefault(at, set()).add(mark)
        elif x is root or not x.out:
            marks.append([0, 1])
            stack.append((x, at, True))
            stack.extend((kid, at if isinstance(kid, str) else f"{at}/{kid.sig}", False) for kid in reversed(x.kids))
    page = marks[0][0]
    return page, {at: next(iter(m)) if len(m) == 1 else _all(m) for at, m in found.items()}


def _all(marks: set[int]) -> int:
    return int.from_bytes(hashlib.blake2b(",".join(map(str, sorted(marks))).encode(), digest_size=7).digest(), "little")


class Agreement:
    """Of each (host, path): least and greatest mark, and up to FIXED_PAGES marks of different pages."""

    def __init__(self):
        self.of: dict[tuple[str, str], list] = {}

    def add(self, host: str, page: int, found: dict[str, int]) -> None:
        for path, mark in found.items():
            had = self.of.get((host, path))
            if had is None:
                self.of[host, path] = [mark, mark, {page}]
                continue
            if mark < had[0]:
                had[0] = mark
            elif mark > had[1]:
                had[1] = mark
            if len(had[2]) < FIXED_PAGES:
                had[2].add(page)


def infer(pages: list[str]) -> dict:
    """{"main": path of the main region, "skip": template paths in it} of a host, from these pages alone."""
    main = infer_main(pages)
    agreed = Agreement()
    for page in pages:
        agreed.add("", *parts(parse(page), main))
    fixed = {path for (_, path), (low, high, seen) in agreed.of.items() if low == high and len(seen) >= FIXED_PAGES}
    return {"main": main, "skip": [] if main in fixed else sorted(fixed)}


def infer_main(pages: list[str]) -> str:
    """The main region of a host from some of its pages."""
    wrapper, seen = None, set()
    for page in pages:
        tree = parse(page)
        key = tuple(blocks(tree))
        if key in seen:
            continue  # a copy tells nothing about what varies
        seen.add(key)
        own = wrap(tree)
        wrapper = own if wrapper is None else align(wrapper, own)
    return region(wrapper, len(seen)) if wrapper else ""


def _at(root: Node, path: str) -> list[tuple[Node, str]]:
    found, stack = [], [(root, "")]
    while stack:
        x, at = stack.pop()
        if at == path:
            found.append((x, at))
        elif path.startswith(at):
            stack.extend((k, f"{at}/{k.sig}") for k in reversed(x.kids) if not isinstance(k, str) and not k.out)
    return found


def extract(page: str | None, rule: dict | None) -> str:
    """Main text of a page by its host's rule, or by its own wrapper if the rule doesn't fit."""
    if not page:
        return ""
    tree = parse(page)
    for known in (rule, None):
        rule_ = known if known is not None else {"main": region(wrap(tree), 1), "skip": []}
        skip = frozenset(rule_["skip"])
        out = [b for node, at in _at(tree, rule_["main"]) for b in blocks(node, skip, at)]
        if out or known is None and rule is None:
            return "\n\n".join(out)
    return "\n\n".join(blocks(tree))


def host_mains(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """host, main of each host: all its pages are aligned, in blocks of about `block`; each block tells a main region, and the one that most pages tell counts, ties by its path."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("_h"), "html").where("html is not null")
    # copies within a host are one page, so a task passes a text of a host on once
    hosts = hosts.mapInArrow(_once, "host string, _h long, html string")
    sizes = pages.where("html is not null").groupBy(host_of(F.col("url")).alias("host")).agg(F.countDistinct(F.xxhash64("html")).alias("_pages"))
    blocks_of = F.ceil(F.col("_pages") / block)
    dealt = hosts.join(sizes, "host").select("host", F.pmod("_h", blocks_of).alias("_block"), "_h", "html")

    def run(key, frame):
        import pandas as pd

        some = frame.drop_duplicates("_h").sort_values("_h")["html"].tolist()
        return pd.DataFrame({"host": [key[0]], "main": [infer_main(some)], "pages": [len(some)]})

    told = dealt.groupBy("host", "_block").applyInPandas(run, "host string, main string, pages long")
    votes = told.groupBy("host", "main").agg(F.sum("pages").alias("pages"))
    return votes.groupBy("host").agg(F.min_by("main", F.struct((-F.col("pages")).alias("n"), "main")).alias("main"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("host").to_pylist(), batch.column("_h").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(seen) > FLUSH:
            seen.clear()  # copies that come again are left out behind the shuffle


def _small(table: DataFrame, *columns: str) -> DataFrame:
    """The table, marked for broadcast if its texts are small."""
    size = table.agg(F.coalesce(F.sum(sum((F.length(c) for c in columns), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def host_templates(pages: DataFrame, mains: DataFrame) -> DataFrame:
    """host, skip: the template paths of each host that has some, counted over all its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agreed = Agreement()

        def flush():
            rows = [(host, path, low, high, page) for (host, path), (low, high, seen) in agreed.of.items() for page in seen]
            agreed.of.clear()
            kinds = {"host": pa.string(), "path": pa.string(), "low": pa.int64(), "high": pa.int64(), "page": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for host, main, page in zip(*(part.column(c).to_pylist() for c in ("host", "main", "html")), strict=True):
                    agreed.add(host, *parts(parse(page), main))
                if len(agreed.of) >= FLUSH:
                    yield flush()
        if agreed.of:
            yield flush()

    hosts = pages.select(host_of(F.col("url")).alias("host"), "html").where("html is not null").join(_small(mains, "host", "main"), "host")
    met = hosts.select("host", "main", "html").mapInArrow(run, "host string, path string, low long, high long, page long")
    pages_of = met.groupBy("host", "path", "page").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    fixed = pages_of.groupBy("host", "path").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).where((F.col("low") == F.col("high")) & (F.col("n") >= FIXED_PAGES))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("skip"))


def host_rules(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """host, rule (JSON) of each host: its main region and its template paths."""
    mains = written(host_mains(pages, block), "host-mains")
    none = F.array().cast("array<string>")
    skip = F.coalesce("skip", none)
    # where all of the region is fixed, it is what the page says
    skip = F.when(F.array_contains(skip, F.col("main")), none).otherwise(skip)
    return mains.join(host_templates(pages, mains), "host", "left").select("host", F.to_json(F.struct("main", skip.alias("skip"))).alias("rule"))


def extract_pages(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rules = written(host_rules(pages, block), "host-rules")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(_small(rules, "host", "rule"), "host", "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = []
                for page, rule in zip(part.column("html").to_pylist(), part.column("rule").to_pylist(), strict=True):
                    if rule not in read:
                        if len(read) > 5000:
                            read = {None: None}
                        read[rule] = json.loads(rule)
                    texts.append(extract(page, read[rule]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
