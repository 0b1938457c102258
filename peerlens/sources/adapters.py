"""Source adapters: raw files or tables to canonical company records. A registry maps a source's name to its adapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.functions import classify as cl
from peerlens.functions import text as tx

from . import company_page, dom

#: Canonical columns of a company record; absent values are null or empty lists.
SCALARS = ["norm", "name", "description", "status", "founded_year", "shutdown_year", "shutdown_date", "location", "country", "city", "total_funding", "headcount", "failure_cause", "post_mortem", "acquirer", "yc_batch", "website", "cnpj", "outcome"]
LISTS = ["founders", "categories", "investors", "competitors", "links"]
SCHEMA = T.StructType([T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in SCALARS], *[T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS]])

ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def adapter(name: str):
    def register(f):
        ADAPTERS[name] = f
        return f

    return register


#: Place of a record in its source: file, block and row.
ORDER = "struct<file: string, block: bigint, row: bigint>"


def in_order(raw: DataFrame) -> DataFrame:
    """Rows of files with their place in `_ord`; an adapter that groups rows takes the least place of a group."""
    return raw.withColumn("_ord", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")))


def canonical(df: DataFrame, source: str) -> DataFrame:
    """The canonical columns of df and the record's place: missing ones are null, blank strings too; rows without a name are rejected.

    Rows that don't come from files in order have no place but the hash of their key and name.
    """
    have = set(df.columns)
    rows = df.where(tx.absent(F.col("name")).isNotNull())
    key = F.coalesce(tx.absent(F.col("norm")), tx.entity_key(F.col("name"))) if "norm" in have else tx.entity_key(F.col("name"))
    out = rows.select(
        F.lit(source).alias("source"),
        tx.absent(key).alias("norm"),
        *[(tx.absent(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")).alias(c) for c in SCALARS if c != "norm"],
        *[(F.filter(F.col(c), lambda x: tx.absent(x).isNotNull()) if c in have else F.array().cast("array<string>")).alias(c) for c in LISTS],
        (F.col("_ord") if "_ord" in have else F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64(key, "name").alias("row"))).cast(ORDER).alias("record_ord"),
    )
    return out.where("norm is not null")


def empty(spark: SparkSession) -> DataFrame:
    """What a gated source gives."""
    return spark.createDataFrame([], SCHEMA).withColumn("record_ord", F.lit(None).cast(ORDER))


def all_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of several sources in order, with source_ord and record_ord (source, file and row order) for the merge."""
    out = None
    for k, (name, path) in enumerate(paths.items()):
        rows = ADAPTERS[name](spark, path).withColumn("source_ord", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return empty(spark).withColumn("source_ord", F.lit(0)) if out is None else out


def years(c: Column) -> Column:
    return cl.first_year(c).cast("string")


@adapter("corpus")
def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file JSON array of records, with the fields of the canonical schema."""
    return canonical(in_order(spark.read.schema(T.StructType([f for f in SCHEMA if f.name not in ("source",)])).json(path, multiLine=True)), "corpus")


@adapter("corpus_lines")
def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same records as JSON lines, as sinks.write_corpus() writes them."""
    return canonical(in_order(spark.read.schema(T.StructType([f for f in SCHEMA if f.name not in ("source",)])).json(path)), "corpus")


@adapter("register")
def register(spark: SparkSession, path: str) -> DataFrame:
    """A public register as CSV, semicolons, Latin-1: legal name, situation, dates, sector, town."""
    return register_records(in_order(spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)))


def register_records(raw: DataFrame) -> DataFrame:
    found = register_status(F.col("SIT"), F.col("MOTIVO_CANCEL"), F.col("SIT_EMISSOR"))
    sit, issuer, reason, sector = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("SIT", "SIT_EMISSOR", "MOTIVO_CANCEL", "SETOR_ATIV"))
    # the text of the source's records (fixed values)
    text = F.concat(
        F.lit("Companhia aberta brasileira registrada na CVM. Setor: "), F.coalesce(F.nullif(sector, F.lit("")), F.lit("n/d")),
        F.lit(". Situação: "), F.coalesce(F.nullif(sit, F.lit("")), F.lit("n/d")),
        F.when((issuer != "") & (issuer != sit), F.concat(F.lit(" ("), issuer, F.lit(")"))).otherwise(""), F.lit("."),
        F.when(reason != "", F.concat(F.lit(" Motivo de cancelamento: "), reason, F.lit("."))).otherwise(""),
    )
    return canonical(
        raw.select(
            F.coalesce(tx.absent(F.col("DENOM_COMERC")), F.col("DENOM_SOCIAL")).alias("name"),
            tx.registry_id(F.col("CNPJ_CIA")).alias("cnpj"),
            found["status"].alias("status"),
            found["outcome"].alias("outcome"),
            found["cause"].alias("failure_cause"),
            years(F.col("DT_CONST")).alias("founded_year"),
            years(F.col("DT_CANCEL")).alias("shutdown_year"),
            F.col("MUN").alias("city"),
            F.lit("Brazil").alias("country"),
            F.array(cl.sector_by_part(F.col("SETOR_ATIV"))).alias("categories"),
            text.alias("description"),
            *(["_ord"] if "_ord" in raw.columns else []),
        ),
        "register",
    )


def register_status(situation: Column, reason: Column, issuer: Column) -> Column:
    """struct<status, outcome, cause> of a register's situation, the reason of its cancellation and the issuer's state."""
    s, r, e = (F.upper(tx.fold_accents(F.coalesce(c, F.lit("")))) for c in (situation, reason, issuer))

    def result(status: str, outcome: str, cause: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(outcome).alias("outcome"), F.lit(cause).cast("string").alias("cause"))

    return (
        F.when(r.rlike("INCORPORA|FUSAO|CISAO"), result("Inactive", "acquired", None))
        .when(r.rlike("FALENCIA|LIQUIDA") | e.rlike("FALENCIA|FALIDA|LIQUIDA"), result("Inactive", "dead", "Lack of Funds"))
        .when(e.contains("RECUPERACAO"), result("Active", "distressed", None))
        .when(s.contains("CANCEL"), result("Inactive", "dormant", None))
        .when(s.contains("SUSPENS"), result("Inactive", "dormant", None))
        .otherwise(result("Active", "operating", None))
    )


@adapter("holdings")
def holdings(spark: SparkSession, path: str) -> DataFrame:
    """Yearly holdings as CSV: one record for each company, with its sectors, years, latest name and last listing flag."""
    return holding_records(in_order(spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)))


def holding_records(raw: DataFrame) -> DataFrame:
    key = F.coalesce(tx.registry_id(F.col("cnpj")), F.lower(F.trim("razao_social")))
    year = cl.leading_year(F.col("ano"))
    own = ["_ord"] if "_ord" in raw.columns else []
    rows = raw.select(key.alias("k"), tx.registry_id(F.col("cnpj")).alias("cnpj"), F.trim("razao_social").alias("name"), year.alias("year"), tx.absent(F.col("setor_de_atividade")).alias("sector"), tx.absent(F.col("aberta_fechada")).alias("listed"), *own)
    made = rows.groupBy("k").agg(
        F.max("cnpj").alias("cnpj"),
        F.max_by("name", F.struct("year", "name")).alias("name"),
        F.array_sort(F.collect_set("sector")).alias("sectors"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.max_by("listed", F.when(F.col("listed").isNotNull(), F.struct("year", "listed"))).alias("listed"),
        *[F.min("_ord").alias("_ord") for _ in own],
    )
    # the text of the source's records (fixed values)
    text = F.concat(
        F.lit("Empresa brasileira com participação acionária da BNDESPar. Ativa no portfólio de "), F.col("first_year").cast("string"), F.lit(" a "), F.col("last_year").cast("string"),
        F.lit(". Setor(es): "), F.coalesce(F.nullif(F.array_join("sectors", ", "), F.lit("")), F.lit("não especificado")),
        F.lit(". Tipo: "), F.when(F.col("listed") == "ABERTA", "listada em bolsa").otherwise("companhia fechada"), F.lit("."),
    )
    categories = F.array_distinct(F.filter(F.transform("sectors", lambda x: cl.sector_by_start(x)), lambda x: x != ""))
    return canonical(made.withColumns({"description": text, "country": F.lit("Brazil"), "status": F.lit("Active"), "categories": categories}), "holdings")


@adapter("accelerator")
def accelerator(spark: SparkSession, path: str) -> DataFrame:
    """Search hits as JSON lines, one for each object id."""
    return accelerator_records(spark.read.json(path))


def accelerator_records(hits: DataFrame) -> DataFrame:
    """Of several hits with one id the one with most fields stays, of those the first as JSON."""
    whole = F.struct(*hits.columns)
    absent = sum((F.col(c).isNull().cast("int") for c in hits.columns), F.lit(0))
    raw = hits.groupBy("id").agg(F.min_by(whole, F.struct(absent, F.to_json(whole))).alias("r")).select("r.*")
    have = set(raw.columns)
    none = F.array().cast("array<string>")
    cats = F.flatten(F.array(*[F.coalesce(F.col(c), none) for c in ("industries", "tags") if c in have], *[F.array(F.col(c)) for c in ("industry", "subindustry") if c in have]))
    parts = F.flatten(F.transform(F.filter(cats, lambda x: x.isNotNull()), lambda x: F.split(x, r"\s*->\s*")))
    rows = raw.select(
        "name",
        F.coalesce(*[tx.absent(F.col(c)) for c in ("long_description", "one_liner") if c in have]).alias("description"),
        "status",
        cl.batch_year(F.col("batch")).cast("string").alias("founded_year"),
        F.col("batch").alias("yc_batch"),
        F.col("team_size").cast("string").alias("headcount"),
        F.col("all_locations").alias("location"),
        tx.country_of_location(F.col("all_locations")).alias("country"),
        tx.city_of_location(F.col("all_locations")).alias("city"),
        "website",
        tx.distinct_ignoring_case(parts).alias("categories"),
    )
    return canonical(rows, "accelerator")


@adapter("knowledge_graph")
def knowledge_graph(spark: SparkSession, path: str) -> DataFrame:
    """Query results as JSON lines: labels, years, joined lists. Labels that are bare ids are rejected; a closing year wins over activity."""
    return knowledge_graph_records(spark.read.json(path))


def with_country(bindings: DataFrame, country: str) -> DataFrame:
    """Bindings of a query that asked for one country only."""
    return bindings.withColumn("country", F.lit(country))


def knowledge_graph_records(bindings: DataFrame) -> DataFrame:
    """Several bindings of one item: the greatest closing year, and of the other fields the least value that is there."""
    raw = bindings.where("not coLabel rlike '^Q[0-9]+$'")
    first = raw.groupBy("co").agg(*[F.max(c).alias(c) if c == "closed" else F.min(c).alias(c) for c in raw.columns if c != "co"])
    closed = cl.leading_year(F.col("closed"))
    rows = first.select(
        F.col("coLabel").alias("name"),
        cl.leading_year(F.col("founded")).cast("string").alias("founded_year"),
        closed.cast("string").alias("shutdown_year"),
        F.when(closed.isNotNull(), "Inactive").otherwise("Active").alias("status"),
        F.col("country"),
        F.split("industries", r" \| ").alias("categories"),
        F.split("founders", r" \| ").alias("founders"),
        "website",
        F.array(F.concat(F.lit("https://www.wikidata.org/wiki/"), tx.uri_tail(F.col("co")))).alias("links"),
    )
    return canonical(rows, "knowledge_graph")


def relaxed_json(text: Column, schema: str) -> Column:
    """Array of a JavaScript literal: bare keys and trailing commas are allowed."""
    array = F.regexp_extract(text, r"(?s)(\[\s*\{.*\}\s*,?\s*\])", 1)
    clean = F.regexp_replace(array, r",\s*([\]}])", "$1")
    return F.from_json(clean, schema, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})


@adapter("ranking")
def ranking(spark: SparkSession, path: str) -> DataFrame:
    """Rankings inside pages: each row once for a company, with all its categories."""
    raw = spark.read.text(path, wholetext=True)
    return ranking_records(raw)


def ranking_records(pages: DataFrame) -> DataFrame:
    """pages: value, the text of a page with its script."""
    rows = pages.select(F.explode(relaxed_json(F.col("value"), "array<struct<rank:int,name:string,location:string,category:string,points:double,description:string>>")).alias("r")).select("r.*")
    rows = rows.withColumn("category", cl.sector_by_name(F.col("category")))
    made = rows.withColumn("norm", tx.entity_key(F.col("name"))).groupBy("norm").agg(
        F.min_by("name", "rank").alias("name"), F.min_by("location", "rank").alias("location"), F.array_sort(F.collect_set("category")).alias("categories"), F.min_by("description", "rank").alias("description")
    )
    return canonical(made.withColumns({"status": F.lit("Active"), "country": F.lit("Brazil"), "city": F.trim(F.split("location", "[,/]")[0])}), "ranking")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url, kind of a sitemap's locations; the kind is the first part of the path."""
    raw = spark.read.format("xml").option("rowTag", "url").load(path)
    return raw.select(F.trim("loc").alias("url")).select("url", F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)/", 1), F.lit("")), F.lit("page")).alias("kind"))


def sitemap_locations(files: DataFrame) -> DataFrame:
    """url, kind of the locations in the texts (`value`) of sitemaps, read by pattern, so that broken XML loses nothing."""
    found = F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    rows = files.select(found.alias("url")).distinct()
    return rows.select("url", F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)/", 1), F.lit("")), F.lit("page")).alias("kind"))


def encyclopedia(pages: DataFrame) -> DataFrame:
    """Records of encyclopedia pages(title, extract, wikitext): infobox fields, status by text."""
    box = tx.infobox(F.col("wikitext"))
    rows = pages.withColumn("box", box)

    def field(*names: str) -> Column:
        return F.coalesce(*[F.element_at("box", n) for n in names])

    status = (
        F.when(F.col("extract").rlike(r"(?i)\b(was|were) acquired\b") | field("fate").rlike("(?i)acquired"), "Acquired")
        .when(F.col("extract").rlike(r"(?i)\b(defunct|ceased operations|shut down|bankrupt)"), "Inactive")
        .when(field("defunct", "fate").isNotNull(), "Inactive")
        .otherwise("Active")
    )
    return canonical(
        rows.where("extract is not null").select(
            F.regexp_replace("title", r"\s*\([^)]*\)$", "").alias("name"),
            F.col("extract").alias("description"),
            status.alias("status"),
            years(field("founded", "foundation")).alias("founded_year"),
            years(field("defunct", "dissolved")).alias("shutdown_year"),
            tx.country_of_location(field("hq_location", "location", "headquarters")).alias("country"),
            F.array(field("industry")).alias("categories"),
            field("num_employees").alias("headcount"),
        ),
        "encyclopedia",
    )


def tax_register(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of look-ups in the tax register as JSON lines: the lookup table of enriched()."""
    return spark.read.schema(PAYLOAD).json(path)


PAYLOAD = "cnpj string, descricao_situacao_cadastral string, data_situacao_cadastral string, data_inicio_atividade string, qsa array<struct<nome_socio: string>>, cnae_fiscal_descricao string, cnaes_secundarios array<struct<descricao: string>>, municipio string, uf string, capital_social double"


def enriched(companies: DataFrame, payloads: DataFrame, source: str = "tax_register") -> DataFrame:
    """Companies with absent fields from their payload, met by the 14-digit number; categories are appended, `sources` grows.

    Of several payloads with one number the one with the latest date of its situation counts.
    """
    key = tx.registry_id(F.col("cnpj"))
    last = F.max_by(F.struct(*payloads.columns), F.struct(F.coalesce("data_situacao_cadastral", F.lit("")), F.coalesce("descricao_situacao_cadastral", F.lit(""))))
    one = payloads.where(key.isNotNull()).groupBy(key.alias("_key")).agg(last.alias("_p"))
    p = lambda c: F.col(f"_p.{c}")
    found = cl.registry_situation(p("descricao_situacao_cadastral"))
    met, shut = F.col("_p").isNotNull(), F.trim(F.upper(F.coalesce(p("descricao_situacao_cadastral"), F.lit("")))) == "BAIXADA"
    none = F.array().cast("array<string>")
    names = F.slice(F.filter(F.transform(p("qsa"), lambda x: x["nome_socio"]), lambda x: F.coalesce(x, F.lit("")) != ""), 1, 10)
    main = tx.absent(p("cnae_fiscal_descricao"))
    more = F.when(main.isNotNull(), F.filter(F.concat(F.array(main), F.coalesce(F.transform(p("cnaes_secundarios"), lambda x: x["descricao"]), none)), lambda x: F.coalesce(x, F.lit("")) != ""))
    town = F.when(tx.absent(p("municipio")).isNotNull() & tx.absent(p("uf")).isNotNull() & tx.absent(F.col("location")).isNull(), p("municipio"))
    money = F.when(p("capital_social") > 0, F.concat(F.lit("BRL "), F.replace(F.format_number(F.floor(p("capital_social")), 0), F.lit(","), F.lit("."))))

    def fill(c: str, value: Column) -> Column:
        return F.coalesce(tx.absent(F.col(c)), F.when(met, tx.absent(value)))

    changed = {
        "status": fill("status", found["status"]),
        "outcome": F.when(met & (F.coalesce(tx.absent(F.col("outcome")), F.lit("unknown")) == "unknown"), found["outcome"]).otherwise(F.col("outcome")),
        "shutdown_date": fill("shutdown_date", F.when(shut, p("data_situacao_cadastral"))),
        "shutdown_year": fill("shutdown_year", F.when(shut, F.left(p("data_situacao_cadastral"), F.lit(4)))),
        "founded_year": fill("founded_year", F.when(F.length(p("data_inicio_atividade")) >= 4, F.left(p("data_inicio_atividade"), F.lit(4)))),
        "founders": F.when(F.size(F.coalesce("founders", none)) == 0, F.coalesce(names, none)).otherwise(F.col("founders")),
        "categories": F.array_union(F.coalesce("categories", none), F.coalesce(more, none)),
        "city": F.coalesce(town, F.col("city")),
        "location": F.coalesce(F.concat(town, F.lit(", "), p("uf")), F.col("location")),
        "total_funding": fill("total_funding", money),
        "sources": F.when(met, F.array_union(F.coalesce("sources", none), F.array(F.lit(source)))).otherwise(F.col("sources")),
    }
    joined = companies.withColumn("_key", key).join(one, "_key", "left")
    return joined.withColumns({c: x for c, x in changed.items() if c in companies.columns}).select(*companies.columns)


@adapter("dump")
def dump(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a report dump, a whole array or JSON lines: the one-liner describes, the slug names the nameless, a post-mortem counts by its content."""
    raw = in_order(spark.read.option("multiLine", "true").json(path))
    have = set(raw.columns)
    text = lambda c: tx.absent(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    mortem = raw.schema["post_mortem"].dataType if "post_mortem" in have else None
    content = F.col("post_mortem.content") if mortem is not None and mortem.typeName() == "struct" and "content" in mortem.names else F.lit(None).cast("string")
    listed = {c: F.coalesce(F.col(s).cast("array<string>"), F.array().cast("array<string>")) for c, s in (("founders", "founders"), ("categories", "categories"), ("competitors", "competitors"), ("links", "sources")) if s in have and raw.schema[s].dataType.typeName() == "array"}
    same = ("status", "founded_year", "shutdown_date", "location", "total_funding", "yc_batch", "website", "acquirer")
    rows = raw.select(F.coalesce(text("name"), text("slug")).alias("name"), F.coalesce(text("one_liner"), text("description")).alias("description"), text("team_size").alias("headcount"), content.alias("post_mortem"), *[text(c).alias(c) for c in same], *[x.alias(c) for c, x in listed.items()], "_ord")
    return canonical(rows, "dump")


@adapter("encyclopedia")
def encyclopedia_files(spark: SparkSession, path: str) -> DataFrame:
    """Encyclopedia pages as JSON lines (title, extract, wikitext)."""
    return encyclopedia(spark.read.schema("title string, extract string, wikitext string").json(path))


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


@adapter("company_pages")
def company_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages of companies (Parquet: page_id, url, html)."""
    rows = company_page.companies(_pages(spark, path)).where("name <> ''")
    return canonical(rows.withColumnsRenamed({"one_liner": "description", "team_size": "headcount"}).withColumn("post_mortem", F.col("post_mortem.content")), "company_pages")


@adapter("listed")
def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages with tables of companies (Parquet: page_id, url, html)."""
    return canonical(company_page.row_companies(dom.grid_rows(_pages(spark, path))), "listed")


@adapter("listicle")
def listicle_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages with cards of failed companies (Parquet: page_id, url, html)."""
    rows = company_page.listicle(dom.nodes(_pages(spark, path)))
    return canonical(rows.withColumns({"location": F.col("country"), "links": F.filter(F.array("deep_link"), lambda x: x != "")}), "listicle")
