import pytest
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


@pytest.mark.parametrize(("name", "key"), [("  Acme, Inc. ", "acme"), ("Foo S.A.", "foo"), ("Bar GmbH & Co", "bar"), ("Café Ltd", "caf"), ("Cocoa", "cocoa")])
def test_entity_key(one, name, key):
    assert one(tx.entity_key(F.lit(name))) == key


def test_keys(one):
    assert one(tx.entity_key_without_parenthesis(F.lit("Foo Inc (company)"))) == "foo"
    assert one(tx.compact_key(F.lit("A b-C"))) == "abc"
    assert one(tx.slug(F.lit("!!"))) == "anon"
    assert one(tx.country_key(F.lit(" U.S.A. "), {"usa": "united states"})) == "united states"
    assert one(tx.country_key(F.lit("São-Tomé"))) == "sãotomé"


@pytest.mark.parametrize(("text", "left"), [("not a marketplace for food", "food"), ("we never not ever did this thing", "we this thing"), ("", ""), ("it isn't one two three four", "it four")])
def test_negation(one, text, left):
    assert one(tx.strip_negated(F.lit(text))) == left


@pytest.mark.parametrize(("a", "b", "near"), [("markteplace", "marketplace", True), ("abc", "abc", True), ("abc", "acb", True), ("abc", "cab", False), ("a", "b", True), ("", "ab", False), ("abcd", "abc", True)])
def test_edit_distance(one, a, b, near):
    assert one(tx.within_one_edit(F.lit(a), F.lit(b))) is near


def test_text(one):
    assert one(tx.first_sentence(F.lit("One v1.2 here. Two."))) == "One v1.2 here."
    assert one(tx.semantic_text(F.lit("N"), F.lit(""), F.lit(""), F.lit("Story told. More"))) == "N Story told."
    assert one(tx.short(F.lit("abcdef"), 4)) == "abc…"
    assert one(tx.registry_id(F.lit("12.345.678/0001-95"))) == "12345678000195"
    assert one(tx.city_of_location(F.lit("San Francisco, CA, USA; Remote"))) == "San Francisco"
    assert one(tx.country_of_location(F.lit("San Francisco, CA, USA; Remote"))) == "USA"
    assert one(tx.distinct_ignoring_case(F.array(F.lit("AI"), F.lit("ai"), F.lit("Bio")))) == ["AI", "Bio"]
    assert one(tx.plain_wiki(F.lit("'''A''' [[b|c]] {{x}}<ref>r</ref> d"))) == "A c d"
    assert one(tx.infobox(F.lit("{{Infobox\n| founded = 1999\n| industry = [[Steel]]\n}}"))) == {"founded": "1999", "industry": "Steel"}
    assert one(tx.tokens(F.lit("É só the Über-Maß"), ["the"])) == ["uber"]


@pytest.mark.parametrize(("status", "bucket"), [("Inactive", "dead"), ("Acquired (closed)", "acquired"), ("Series B", "operating"), ("Unfunded", "unknown"), (None, "unknown"), ("Active", "operating")])
def test_outcome(one, status, bucket):
    assert one(cl.outcome(F.lit(status).cast("string"))) == bucket


@pytest.mark.parametrize(("text", "band"), [("1-10", 1), ("50", 4), ("100 - 250", 6), ("1,200", 5), ("20000", 9), ("0", None), ("many", None), (None, None)])
def test_headcount(one, text, band):
    assert one(cl.headcount_band(F.lit(text).cast("string"))) == band


@pytest.mark.parametrize(("text", "v"), [("Series A", 4), ("late stage round", 7), ("", None), ("nothing", None), (" Pre-Seed ", 1)])
def test_stage(one, text, v):
    assert one(cl.stage_ordinal(F.lit(text))) == v


def test_years_and_money(one):
    assert one(cl.batch_year(F.lit("W21"))) == 2021 and one(cl.batch_year(F.lit("Summer 2009"))) == 2009
    assert one(cl.decade(F.lit(2017))) == "2010s" and one(cl.decade(F.lit(None).cast("int"))) == "unknown"
    e = one(cl.entities(F.lit("Raised US$ 2,5 million in series B, 2019 and 2017, 40 employees")))
    assert (e.money, e.round, e.year, e.years, e.headcount) == (2.5e6, "series b", 2017, [2017, 2019], 40)


def test_cause(one):
    lexicon = {"A": ["ran out", "cash"], "B": ["lost to"], "C": ["too early"]}
    assert one(cl.infer_cause(F.lit("we ran out of cash and stopped"), lexicon)).asDict() == {"cause": "A", "evidence": "we ran out of cash and stopped", "confidence": "high"}
    assert one(cl.infer_cause(F.lit("ran out, lost to them, too early!"), lexicon)).cause == "Multiple Reasons"
    assert one(cl.infer_cause(F.lit("short cash"), lexicon)) is None


def test_macros(one):
    found = one(cl.categories_to_macros(F.array(F.lit("FinTech"), F.lit(""), F.lit("ed")), {"fin": ["fintech", "bank"], "edu": ["edtech"], "x": ["zzz"]}))
    assert found == ["edu", "fin"]


def test_sql_functions_equal_expressions(spark):
    from peerlens.functions import sql

    assert "entity_key" in sql.register(spark)
    df = spark.createDataFrame([(" Acme, Inc. ", "Inactive"), ("Foo S.A.", "Series B"), ("É só the Über", "Acquired"), (None, None)], "s string, t string")
    df.createOrReplaceTempView("sql_functions_test")
    a = spark.sql("SELECT entity_key(s) AS k, compact_key(s) AS c, text_tokens(s) AS w, outcome_bucket(t) AS o FROM sql_functions_test").collect()
    b = df.select(tx.entity_key(F.col("s")).alias("k"), tx.compact_key(F.col("s")).alias("c"), tx.tokens(F.col("s")).alias("w"), cl.outcome(F.col("t")).alias("o")).collect()
    assert a == b


def test_entities_in_all_forms(one):
    def e(text):
        return one(cl.entities(F.lit(text)))

    for text, money in (("usd 3 mm", 3e6), ("BRL 2,5 milhões", 2.5e6), ("u$s 7k", 7e3), ("gbp 1bn", 1e9), ("R$ 1.500 mil", 1.5e6), ("£2 bilhão", 2e9), ("$ 5 mikes", 5.0), ("€9", 9.0), ("eur 4 million", 4e6)):
        assert e(text).money == money, text
    for text, found in (("an angel", "angel"), ("Série F now", "série f"), ("series g", None), ("seedling", None), ("pre seed", "pre seed"), ("bootstrapped", "bootstrapped"), ("Revenue Based", "revenue based"), ("IPO!", "ipo"), ("anjo", "anjo")):
        assert e(text).round == found, text
    for text, n in (("12 funcs", 12), ("3 devs", 3), ("40 staff", 40), ("7 colabs", 7), ("8 colaboradores", 8), ("15 funcionários", 15), ("9 stafford", None)):
        assert e(text).headcount == n, text
    assert e("2040 and 2039 and 1899").years == [2039]


def test_infobox_runs_over_lines(one):
    box = one(tx.infobox(F.lit("before {{Infobox company\n| name = One\n| key_people2 = [[Ann Bo|Ann]]\n* and [[Cy]]<br/>Di,\n| empty =\n| Num Employees = 5\n|name = Two\n| list = a = b | c\n}}\nafter | x = y")))
    assert box == {"name": "Two", "key_people2": "Ann * and Cy; Di", "num_employees": "5", "list": "a = b | c"}
    assert one(tx.infobox(F.lit("no box"))) == {} and one(tx.infobox(F.lit(None).cast("string"))) is None


def test_competitors_stand_right_behind_a_cue(one):
    assert one(tx.competitor_names(F.lit("It competes  with Acme Two Three; vs.Beta, versus gamma, competitors: Delta vs Acme Two; competitorX competitor Y9"))) == ["Acme Two", "Beta", "Delta", "Y9"]
    assert one(tx.competitor_names(F.lit(None).cast("string"))) == []


def test_infer_cause_looks_for_each_phrase_once(spark):
    from peerlens.functions import lexicons as lx

    text = F.concat(F.lit("we ran out of cash, a lawsuit "), F.col("id").cast("string"))
    df = spark.range(1, 3).select("id", F.inline_outer(F.array(cl.infer_cause(text, lx.CAUSE_LEXICON)))).where("cause is not null").select("id", "cause", "confidence")
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 1
    assert sorted(map(tuple, df.collect())) == [(1, "Lack of Funds", "low"), (2, "Lack of Funds", "low")]
