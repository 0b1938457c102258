"""Classification, dates, numbers and extraction from text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx


def is_dead(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).rlike("|".join(lx.DEAD_MARKERS))


def outcome(status: Column) -> Column:
    """acquired, dead, operating or unknown; the order matters, since "inactive" contains "active"."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.contains("acquired"), "acquired").when(is_dead(status), "dead").when(s.rlike("|".join(lx.OPERATING_MARKERS)), "operating").otherwise("unknown")


def leading_year(s: Column) -> Column:
    return F.regexp_extract(F.coalesce(s, F.lit("")), r"^\s*(\d{4})", 1).try_cast("int")


def first_year(s: Column) -> Column:
    return F.regexp_extract(F.coalesce(s, F.lit("")), r"((?:19|20)\d{2})", 1).try_cast("int")


def first_number(s: Column) -> Column:
    """First four digits in a row, else the first digits."""
    s = F.coalesce(s, F.lit(""))
    return F.coalesce(F.regexp_extract(s, r"(\d{4})", 1).try_cast("int"), F.regexp_extract(s, r"(\d+)", 1).try_cast("int"))


def decade(year: Column) -> Column:
    return F.when(year.between(1900, 2030), F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))).otherwise("unknown")


def batch_year(batch: Column) -> Column:
    """Year of a batch label such as "Winter 2021", "W21" or "s09"."""
    long = F.regexp_extract(batch, r"(\d{4})", 1).try_cast("int")
    two = F.regexp_extract(batch, r"(?i)^[a-z]+\s*(\d{2})$", 1).try_cast("int")
    return F.coalesce(long, F.when(two < 50, 2000 + two).otherwise(1900 + two))


def headcount_band(s: Column) -> Column:
    """Ordinal of the band that holds the midpoint of the first and last number in the text."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), " ", ""), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))
    first, last = F.get(numbers, F.lit(0)), F.element_at(numbers, -1)
    mid = F.when(F.size(numbers) == 1, first).when(F.size(numbers) > 1, F.floor((first + last) / 2))
    band = F.when(mid > lx.HEADCOUNT_BANDS[-1][1], F.lit(lx.HEADCOUNT_BANDS[-1][2]))
    for low, high, at in lx.HEADCOUNT_BANDS:
        band = band.when(mid.between(low, high), F.lit(at))
    return band


def stage_ordinal(s: Column) -> Column:
    """Exact name first, then the first name contained, in the order of the table."""
    k = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    exact = F.element_at(F.create_map(*[F.lit(x) for kv in lx.STAGES for x in kv]), k)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("v")) for n, v in lx.STAGES])
    inside = F.get(F.filter(table, lambda e: F.contains(k, e["name"])), F.lit(0))["v"]
    return F.when(k != "", F.coalesce(exact, inside))


def implicit_stage(headcount: Column) -> Column:
    return F.least(F.lit(8), F.greatest(F.lit(0), headcount_band(headcount) - 1))


def money(number: Column, unit: Column) -> Column:
    """Number of a money expression: dots group thousands, a comma is decimal; then the factor of its unit."""
    value = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    factors = F.create_map(*[F.lit(x) for kv in lx.MONEY_UNITS.items() for x in kv])
    return value * F.coalesce(F.element_at(factors, F.lower(F.coalesce(unit, F.lit("")))), F.lit(1.0))


def any_of(words: list[str]) -> str:
    """A pattern for any of some literal words, the longest first; blanks match any white space."""
    parts = sorted((re.escape(w).replace("\\ ", r"\s+") for w in words), key=len, reverse=True)
    return "(?:" + "|".join(parts) + ")"


MONEY = rf"(?i){any_of(lx.CURRENCIES)}\s*([0-9][0-9.,]*)(?:\s*({any_of(list(lx.MONEY_UNITS))})(?![\p{{L}}0-9]))?"
ROUND = rf"(?i)(?<![\p{{L}}0-9])({any_of(lx.ROUND_WORDS)}|{any_of(lx.ROUND_SERIES)}\s?[a-f])(?![\p{{L}}0-9])"
YEAR = r"\b(19[0-9]{2}|20[0-3][0-9])\b"
STAFF = rf"(?i)\b([0-9]{{1,4}})\s*{any_of(lx.STAFF_WORDS)}(?![\p{{L}}0-9])"


def entities(text: Column) -> Column:
    """First money, first round, least year (1900 to 2039), all years and first headcount that a text names."""
    t = F.coalesce(text, F.lit(""))
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))
    return F.struct(
        money(F.nullif(F.regexp_extract(t, MONEY, 1), F.lit("")), F.regexp_extract(t, MONEY, 2)).alias("money"),
        F.nullif(F.lower(F.regexp_extract(t, ROUND, 1)), F.lit("")).alias("round"),
        F.array_min(years).alias("year"),
        years.alias("years"),
        F.regexp_extract(t, STAFF, 1).try_cast("int").alias("headcount"),
    )


def share(a: Column, b: Column) -> Column:
    """a / b to four decimals, rounded half up; null without data."""
    return round4(F.try_divide(a, b))


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def lifespan_band(years: Column) -> Column:
    band = None
    for low, high, name in lx.LIFESPAN_BANDS:
        test = (years >= low) & (years < high)
        band = F.when(test, name) if band is None else band.when(test, name)
    return band


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: an expression that is repeated is computed again each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def infer_cause(text: Column, lexicon: dict[str, list[str]], shortest: int = 20) -> Column:
    """struct<cause, evidence, confidence>: the cause with most phrases in the text; three causes or more are Multiple Reasons.

    Ties go to the cause that stands first in the lexicon; the evidence is the text around its first phrase.
    """
    table = F.array(*[F.struct(F.lit(-k).alias("first"), F.lit(cause).alias("cause"), F.array(*[F.lit(p) for p in phrases]).alias("phrases")) for k, (cause, phrases) in enumerate(lexicon.items())])

    def told(t: Column, met: Column) -> Column:
        best, lead = F.array_max(F.transform(met, lambda x: F.struct(F.size(x["said"]).alias("n"), x["first"], x["cause"], x["said"]))), F.get(met, F.lit(0))
        many = F.size(met) >= 3
        at = F.instr(t, F.get(F.when(many, lead["said"]).otherwise(best["said"]), F.lit(0)))
        return F.when(F.size(met) > 0, F.struct(
            F.when(many, "Multiple Reasons").otherwise(best["cause"]).alias("cause"),
            F.trim(F.substring(F.coalesce(text, F.lit("")), F.greatest(at - 40, F.lit(1)), F.lit(100))).alias("evidence"),
            F.when(many, "medium").when(best["n"] >= 2, "high").otherwise("low").alias("confidence"),
        ))

    def found(t: Column) -> Column:
        said = F.transform(table, lambda c: F.struct(c["first"], c["cause"], F.filter(c["phrases"], lambda p: F.contains(t, p)).alias("said")))
        return once(F.filter(said, lambda x: F.size(x["said"]) > 0), lambda met: told(t, met))

    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(lower) >= shortest, once(lower, found))


def categories_to_macros(categories: Column, macros: dict[str, list[str]]) -> Column:
    """Sorted macros of which a keyword contains a category or is contained in one; the table of keywords is a parameter."""
    cats = F.filter(F.transform(categories, lambda c: F.lower(F.trim(c))), lambda c: c != "")

    def met(keywords: list[str]) -> Column:
        table = F.array(*[F.lit(k) for k in keywords])
        return F.exists(cats, lambda c: F.exists(table, lambda k: F.contains(c, k) | F.contains(k, c)))

    hits = [F.when(met(keywords), F.lit(m)) for m, keywords in macros.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def sector_by_part(s: Column, table: list[tuple[str, str]] = lx.REGISTER_SECTORS) -> Column:
    """Sector of the first part that the text contains, else the text in title case; an absent text gives ''."""
    key = F.trim(F.upper(F.replace(F.coalesce(s, F.lit("")), F.lit("�"), F.lit(""))))
    found = F.coalesce(*[F.when(F.contains(key, F.lit(part)), F.lit(name)) for part, name in table])
    return F.when(F.coalesce(s, F.lit("")) == "", "").otherwise(F.coalesce(found, F.initcap(s)))


def sector_by_start(s: Column, table: list[tuple[str, str]] = lx.HOLDING_SECTORS, n: int = 10) -> Column:
    """Sector of the first entry whose first n characters the text begins with, else the text in title case."""
    key = F.trim(F.upper(F.replace(F.coalesce(s, F.lit("")), F.lit("?"), F.lit(""))))
    found = F.coalesce(*[F.when(key.startswith(start[:n]), F.lit(name)) for start, name in table])
    return F.when(F.coalesce(s, F.lit("")) == "", "").otherwise(F.coalesce(found, F.initcap(s)))


def sector_by_name(s: Column, table: dict[str, str] = lx.RANKING_CATEGORIES) -> Column:
    """Sector of an exact name, else the name itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s), s)


def lite_macros(categories: Column, macros: Column | None = None, table: dict[str, list[str]] = lx.LITE_MACROS) -> Column:
    """Macros that are there already, else those one of whose keywords equals a category, in the order of the table."""
    lower = F.transform(categories, lambda c: F.lower(F.coalesce(c, F.lit(""))))
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(lower, F.array(*[F.lit(k) for k in keywords])), F.lit(m)) for m, keywords in table.items()]))
    return found if macros is None else F.when(F.size(macros) > 0, macros).otherwise(found)


def registry_situation(s: Column) -> Column:
    """struct<status, outcome> of a situation in the tax register; others have status '' and an unknown outcome."""
    key = F.trim(F.upper(F.coalesce(s, F.lit(""))))
    out = None
    for name, (status, result) in lx.REGISTRY_SITUATIONS.items():
        value = F.struct(F.lit(status).alias("status"), F.lit(result).alias("outcome"))
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(F.struct(F.lit("").alias("status"), F.lit("unknown").alias("outcome")))


def probe_alive(code: Column) -> Column:
    """A site answers if its status code is in 200..399; no code is no answer."""
    return F.coalesce(code.between(200, 399), F.lit(False))
