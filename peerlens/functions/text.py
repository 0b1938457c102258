"""Normalisation and string expressions. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

_SUFFIX = r"\b(" + "|".join(re.escape(s) for s in sorted(lx.CORPORATE_SUFFIXES, key=len, reverse=True)) + r")\b\.?"


def absent(c: Column) -> Column:
    """Null for null, empty and blank strings: the one rule for what counts as absent."""
    return F.nullif(F.trim(c), F.lit(""))


def entity_key(name: Column) -> Column:
    """Key under which records of one company meet: lower case, no corporate suffix, runs of other characters as one hyphen."""
    bare = F.regexp_replace(F.lower(F.trim(name)), _SUFFIX, "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def entity_key_without_parenthesis(name: Column) -> Column:
    """entity_key() after a trailing "(...)" is taken off."""
    return entity_key(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def compact_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "")


def slug(s: Column, default: str = "anon") -> Column:
    hyphenated = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(hyphenated, F.lit("")), F.lit(default))


def fold_accents(s: Column) -> Column:
    return F.translate(F.lower(s), lx.ACCENTED, lx.FOLDED)


def country_key(s: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case without punctuation, then through an alias table; names without an alias stay."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), r"(?U)[^\w\s]", "")
    if not aliases:
        return bare
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(table, bare), bare)


def tokens(s: Column, stopwords: list[str] | None = None) -> Column:
    """Words of three characters or more after accent folding, without stop words."""
    found = F.regexp_extract_all(fold_accents(F.coalesce(s, F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    stop = lx.STOPWORDS if stopwords is None else stopwords
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def translated(words: Column, dictionary: dict[str, str]) -> Column:
    """Words through a dictionary; a translation of several words gives several."""
    if not dictionary:
        return words
    table = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.flatten(F.transform(words, lambda t: F.split(F.coalesce(F.element_at(table, t), t), " ")))


def replaced_phrases(s: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced in the order of the dictionary."""
    for old, new in phrases.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def strip_negated(s: Column, markers: list[str] | None = None, window: int = lx.NEGATION_WINDOW) -> Column:
    """Drops each negation marker and the words after it; a marker inside a dropped span starts no new one."""
    marks = lx.NEGATION_MARKERS if markers is None else markers
    words = F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\s+"), lambda w: w != "")

    def step(state: Column, word: Column) -> Column:
        bare = F.regexp_replace(word, "[^a-z0-9']", "")
        starts = bare.isin(marks) | bare.endswith("n't")
        return (
            F.when(state["skip"] > 0, F.struct((state["skip"] - 1).alias("skip"), state["out"].alias("out")))
            .when(starts, F.struct(F.lit(window).alias("skip"), state["out"].alias("out")))
            .otherwise(F.struct(state["skip"].alias("skip"), F.concat(state["out"], F.array(word)).alias("out")))
        )

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(words, start, step, lambda state: F.array_join(state["out"], " "))


def within_one_edit(a: Column, b: Column) -> Column:
    """Edit distance of at most one: insertion, deletion, substitution, or a swap of neighbours."""
    n = F.length(a)
    swap = (n == F.length(b)) & (n >= 2) & F.exists(
        F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(0))),
        lambda i: (i > 0) & (F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b),
    )
    return F.levenshtein(a, b, 1).between(0, 1) | swap


def first_sentence(s: Column, most: int = 180) -> Column:
    t = F.trim(F.coalesce(s, F.lit("")))
    found = F.regexp_extract(F.substring(t, 1, 200), r"(?s)^(.*?\.)(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(F.left(t, F.lit(most)))


def semantic_text(name: Column, one_liner: Column, description: Column, narrative: Column, most: int = 400) -> Column:
    """Text for an encoder: name, one-liner and first sentence; the narrative only if both are absent."""
    sentence = absent(first_sentence(description))
    rest = F.when(absent(one_liner).isNull() & sentence.isNull(), absent(first_sentence(narrative)))
    return F.left(F.concat_ws(" ", absent(name), absent(one_liner), sentence, rest), F.lit(most))


def short(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def digits(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")


def registry_id(s: Column) -> Column:
    """A 14-digit registry number, or null."""
    return F.when(F.length(digits(s)) == 14, digits(s))


def country_of_location(s: Column, aliases: dict[str, str] | None = None) -> Column:
    """Last comma part of the first semicolon part."""
    last = F.trim(F.element_at(F.split(F.split(s, ";")[0], ","), -1))
    if not aliases:
        return last
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(last)), last)


def city_of_location(s: Column) -> Column:
    parts = F.split(F.split(s, ";")[0], ",")
    return F.when(F.size(parts) > 1, F.trim(parts[0]))


def distinct_ignoring_case(words: Column) -> Column:
    """First of each spelling, in order."""
    lower = F.transform(words, F.lower)
    return F.filter(words, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def uri_tail(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def with_scheme(url: Column) -> Column:
    u = absent(url)
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def valid_slug(s: Column, blocked: list[str] | None = None) -> Column:
    return F.length(s).between(3, 80) & s.rlike("^[a-z0-9][a-z0-9-]*$") & ~s.isin(blocked or ["-"])


def mentions(s: Column, needles: list[str]) -> Column:
    """True if any of the needles occurs, whatever the case."""
    t = F.lower(F.coalesce(s, F.lit("")))
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(t, n))


def plain_wiki(s: Column) -> Column:
    """Wiki markup to text: comments, references, templates, links, tags and quotes, in that order."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"\[\S+ ([^\]]*)\]", "$1"), (r"<[^>]+>", " "), ("'{2,}", ""), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def infobox(s: Column) -> Column:
    """Map of the "| key = value" entries of an infobox; a value runs on to the next entry or the end of the box.

    Keys begin with a letter or underscore, may have digits, and are in lower case with underscores; of repeated keys the last counts.
    Template marks within a value go, line breaks of the markup become semicolons; empty values are left out.
    """
    body = F.regexp_replace(F.regexp_replace(s, r"(?s)^.*?\{\{\s*[Ii]nfobox[^\n|]*", ""), r"(?m)^\s*\}\}\s*$(?s:.*)", "")
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n\s*\|(?=\s*[A-Za-z_][A-Za-z0-9_ \t]*=)"), 2, 1_000_000)
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.replace(F.lower(F.trim(F.substring_index(p, "=", 1))), F.lit(" "), F.lit("_")).alias("key"),
            F.regexp_replace(plain_wiki(F.regexp_replace(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1), r"(?i)<br\s*/?>", "; ")), r"^[ ,;|]+|[ ,;|]+$", "").alias("value"),
        ),
    )
    full = F.filter(pairs, lambda p: p["value"] != "")
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, 1_000_000), p["key"]))
    return F.map_from_entries(F.filter(last, lambda p: (p["value"] != "") & (F.size(full) > 0)))


def flattened(*parts: Column) -> Column:
    """All strings of strings, lists of strings and lists of lists (map_values() for maps) as one text, in order; absent parts add nothing."""
    return F.concat_ws(" ", *parts)


def related_slugs(html: Column, own: Column) -> Column:
    """Slugs of links to companies other than the page's own, distinct, in page order."""
    found = F.regexp_extract_all(html, F.lit(r'href="[^"]*/company/([^"]*)"'), F.lit(1))
    bare = F.transform(found, lambda s: F.regexp_replace(s, "^/+|/+$", ""))
    return F.array_distinct(F.filter(bare, lambda s: (s != "") & ~F.contains(s, own)))


#: One or two words, each a capital letter and more letters or digits.
RIVAL_NAME = "^[A-Z][A-Za-z0-9]+(?:\\s+[A-Z][A-Za-z0-9]+)?"
_CUT = "\x1f"


def competitor_names(s: Column) -> Column:
    """Names behind "vs", "versus", "competes with" and "competitor:", distinct, in order.

    The text is cut at the cues; a piece counts if a name stands at its very beginning.
    """
    cut = F.coalesce(s, F.lit(""))
    for phrase in sorted(lx.RIVAL_TITLES, key=len, reverse=True):
        cut = F.regexp_replace(cut, re.escape(phrase) + r"[:\s]+", _CUT)
    for phrase in sorted(lx.RIVAL_CUES, key=len, reverse=True):
        cut = F.regexp_replace(cut, re.escape(phrase).replace("\\ ", r"\s+") + r"\s*", _CUT)
    pieces = F.slice(F.split(cut, _CUT), 2, 1_000_000)
    names = F.transform(pieces, lambda p: F.regexp_extract(p, RIVAL_NAME, 0))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def unique_id() -> Column:
    """A random id; not deterministic, so a table of ids must be written before it is read twice."""
    return F.uuid()


def token() -> Column:
    """128 random bits, safe in a URL; not deterministic, as unique_id()."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))), "+/", "-_"), F.lit("="))
