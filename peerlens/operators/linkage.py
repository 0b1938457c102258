"""Record linkage: merge by entity key with provenance, upserts by policy, keep-first, roll-ups and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import text as tx
from peerlens.sources.sinks import stored


def facts(records: DataFrame, scalars: list[str], key: str = "norm", order: tuple[str, ...] = ("source_ord", "record_ord"), source: str = "source") -> DataFrame:
    """key, field, source, value, n, first: who says what of an entity, how often, and where first; the provenance in long form.

    Equal statements are added up where they are read, and a key is spread by field, source and value, so one that has a third of all rows is no hot task.
    """
    value = lambda f: tx.absent(F.col(f).cast("string"))
    said = F.array_compact(F.array(*[F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("field"), value(f).alias("value"))) for f in scalars]))
    rows = records.where(tx.absent(F.col(key)).isNotNull()).select(key, F.col(source).alias("source"), F.struct(*order).alias("_seq"), F.explode(said).alias("_f"))
    return rows.groupBy(key, F.col("_f.field").alias("field"), "source", F.col("_f.value").alias("value")).agg(F.count("*").alias("n"), F.min("_seq").alias("first"))


def items(records: DataFrame, lists: list[str], key: str = "norm", order: tuple[str, ...] = ("source_ord", "record_ord")) -> DataFrame:
    """key, field, value, first: distinct present items of list columns, and where each stands first."""
    def listed(f: str) -> Column:
        return F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(f).alias("field"), v.alias("value"), i.alias("at")))

    said = F.flatten(F.array(*[listed(f) for f in lists]))
    rows = records.where(tx.absent(F.col(key)).isNotNull()).select(key, *order, F.explode(said).alias("_i")).where(tx.absent(F.col("_i.value")).isNotNull())
    return rows.groupBy(key, F.col("_i.field").alias("field"), F.col("_i.value").alias("value")).agg(F.min(F.struct(*order, F.col("_i.at"))).alias("first"))


def raw_per_source(records: DataFrame, key: str = "norm", order: tuple[str, ...] = ("source_ord", "record_ord"), source: str = "source") -> DataFrame:
    """key, source, raw (VARIANT), first, records: the last record that each source has of an entity, with its present columns only."""
    seq = F.struct(*order)
    rows = records.where(tx.absent(F.col(key)).isNotNull())
    made = rows.groupBy(key, F.col(source).alias("source")).agg(F.max_by(F.to_json(F.struct(*records.columns)), seq).alias("raw"), F.min(seq).alias("first"), F.count("*").alias("records"))
    return made.withColumn("raw", F.parse_json("raw"))


def _in_order(entries: Column, what: str) -> Column:
    return F.transform(F.array_sort(entries), lambda e: e[what])


def merge_records(records: DataFrame, scalars: list[str], lists: list[str] = (), key: str = "norm", order: tuple[str, ...] = ("source_ord", "record_ord"), source: str = "source", raw: bool = False) -> DataFrame:
    """One row for each entity: first present scalars, ordered unions of lists, sources, and the log of who said what.

    `provenance` maps a field to its distinct (source, value) pairs in order, with the number of records; `aliases` holds other spellings of the
    name; with `raw`, `raw_per_source` maps a source to its last record. Rows are put together from facts(), items() and sources, which are
    aggregated before they meet by key; what has more of them than a row should hold is read from these tables.
    """
    said = facts(records, scalars, key, order, source)
    of = said.groupBy(key).agg(
        *[F.min_by("value", F.when(F.col("field") == f, F.col("first"))).alias(f) for f in scalars],
        F.array_sort(F.collect_list(F.struct("first", "field", "source", "value", "n"))).alias("_log"),
    )
    kept = raw_per_source(records, key, order, source)
    known = kept.groupBy(key).agg(
        _in_order(F.collect_list(F.struct("first", "source")), "source").alias("sources"),  # as many as there are sources
        *([F.map_from_entries(F.collect_list(F.struct("source", "raw"))).alias("raw_per_source")] if raw else []),
    )
    made = known.join(of, key, "left")
    if lists:
        each = [_in_order(F.collect_list(F.when(F.col("field") == f, F.struct("first", "value"))), "value").alias(f) for f in lists]
        made = made.join(items(records, list(lists), key, order).groupBy(key).agg(*each), key, "left")
    log = F.coalesce("_log", F.array().cast(of.schema["_log"].dataType))
    fields = F.array_distinct(F.transform(log, lambda e: e["field"]))
    provenance = F.map_from_arrays(fields, F.transform(fields, lambda f: F.transform(F.filter(log, lambda e: e["field"] == f), lambda e: F.struct(e["source"], e["value"], e["n"]))))
    columns = [key, *scalars, *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in lists], "sources", *(["raw_per_source"] if raw else []), provenance.alias("provenance")]
    if "name" in scalars:
        names = F.array_distinct(F.transform(F.filter(log, lambda e: e["field"] == "name"), lambda e: e["value"]))
        columns.append(F.filter(names, lambda x: x != F.col("name")).alias("aliases"))
    return made.select(*columns)


def upsert(corpus: DataFrame, new: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """Corpus with new rows merged in. policies: field -> fill, overwrite, longest, union or outcome.

    fill keeps what is present; overwrite takes what is new; longest keeps the longer text; union joins lists
    without repeats; outcome replaces only an absent or unknown value. New keys are inserted.
    """
    a, b = corpus.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def merged(field: str) -> Column:
        old = F.col(f"a.{field}") if field in corpus.columns else F.lit(None)
        fresh = F.col(f"b.{field}") if field in new.columns else F.lit(None)
        match policies.get(field, "fill"):
            case "overwrite":
                return F.coalesce(tx.absent(fresh), old)
            case "longest":
                return F.when(F.length(F.coalesce(fresh, F.lit(""))) > F.length(F.coalesce(old, F.lit(""))), fresh).otherwise(old)
            case "union":
                none = F.array().cast("array<string>")
                return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(fresh, none)))
            case "outcome":
                return F.when(F.coalesce(tx.absent(old), F.lit("unknown")) == "unknown", F.coalesce(tx.absent(fresh), old)).otherwise(old)
            case "keep":
                return F.coalesce(old, fresh)
            case _:
                return F.coalesce(tx.absent(old), tx.absent(fresh))

    columns = [c for c in dict.fromkeys([*corpus.columns, *new.columns]) if c != key]
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *[merged(c).alias(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Absent fields from a lookup table by key; present ones stay. Of several lookup rows with one key the least present value of each field counts, so rows don't multiply."""
    other = lookup.groupBy(key).agg(*[F.min(tx.absent(F.col(f))).alias(f"_{f}") for f in fields])
    joined = df.join(other, key, "left")
    return joined.withColumns({f: F.coalesce(tx.absent(F.col(f)), F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


def apply_patches(df: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with curated values, and the patches that met no row. Of several patches with one key the least present value of each field counts, so rows don't multiply."""
    other = patches.groupBy(key).agg(*[F.min(f).alias(f"_{f}") for f in fields])
    joined = df.join(other, key, "left").withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])
    return joined, patches.join(df, key, "left_anti")


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return new.join(seen, key, "left_anti")


def numbered_within(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """df with the place of each row, from 1, within its group. Groups may be of any size: rows are sorted by ranges of group and order, and a range begins where the ranges before it end."""
    ranged = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    starts = ranged.groupBy(group, part.alias("_p")).agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))  # rows: groups and ranges
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(group).alias("_g"), "_p", "_first", before.alias("_before"))
    joined = ranged.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    return joined.withColumn(out, (F.col("_m") - F.col("_first") + F.col("_before") + 1)).drop("_m", "_g", "_p", "_first", "_before")


def with_suffix_on_collision(df: DataFrame, slug: str, order: list[str], out: str) -> DataFrame:
    """Unique ids from slugs: the second and later rows of one slug get -2, -3 and so on."""
    rows = numbered_within(df, slug, order, "_n")
    return rows.withColumn(out, F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def looked_up_by_keys(df: DataFrame, lookup: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """df with `value` from a lookup table by the first of several alternative keys that meets a row; of rows with one key the longest, then least value."""
    one = lookup.groupBy(key).agg(F.min_by(value, F.struct(-F.length(value), F.col(value))).alias(value))
    out = df
    for i, k in enumerate(keys):
        out = out.join(one.select(F.col(key).alias(k), F.col(value).alias(f"_v{i}")), k, "left")
    return out.select(*df.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))]).alias(value))


def narratives(reports: DataFrame, sections: list[str], raw: str, paywall: list[str], shortest: int = 80) -> DataFrame:
    """key, narrative of raw reports, one row for each key a report may be looked up by: its name without parenthesis, and its full name."""
    free = F.when(~tx.mentions(F.col(raw), paywall), tx.absent(F.col(raw)))
    text = F.trim(tx.flattened(*[tx.absent(F.col(c)) for c in sections], free))
    clean, full = tx.absent(tx.entity_key_without_parenthesis(F.col("name"))), tx.absent(tx.entity_key(F.col("name")))
    keys = F.explode(F.array_distinct(F.array_compact(F.array(F.coalesce(clean, full), full))))
    return reports.select(keys.alias("key"), text.alias("narrative")).where(F.length("narrative") > shortest)


def multi_match(df: DataFrame, lookup: DataFrame, key: str, out: str) -> DataFrame:
    """df with the sorted distinct `name`s of all lookup rows that share its key; an empty list without any."""
    names = lookup.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias(out))
    return df.join(names, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def status_upgrade(rows: DataFrame, key: str) -> DataFrame:
    """key, statuses, status: keep-first over sources that list a company as active and as dissolved; dissolved wins."""
    made = rows.groupBy(key).agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.count_if(F.lower("status").isin("dissolved", "inactive")).alias("_gone"))
    return made.select(key, "statuses", F.when(F.col("_gone") > 0, "Inactive").otherwise("Active").alias("status"))
