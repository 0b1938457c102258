"""Follow-up lifecycle in batch: schedules, due rows, responses, silent deaths, promotion and erasure.

Every operator takes tables and the time `now` and returns the new rows or the rewritten table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx


def schedule(companies: DataFrame, queue: DataFrame | None = None, offsets: list[int] | None = None) -> DataFrame:
    """Pending follow-ups of companies with consent and an email, one for each offset that isn't queued yet."""
    days = F.array(*[F.lit(d) for d in (offsets or lx.FOLLOWUP_DAYS)])
    rows = companies.where("consent_followup and email is not null and email <> ''").select("company_id", "email", "created_at", F.explode(days).alias("days_offset"))
    rows = rows.select("company_id", "email", "days_offset", (F.col("created_at") + F.make_dt_interval(F.col("days_offset"))).alias("scheduled_for"), F.lit("pending").alias("status"))
    return rows if queue is None else rows.join(queue.select("company_id", "days_offset"), ["company_id", "days_offset"], "left_anti").select(rows.columns)


def due(queue: DataFrame, companies: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Pending rows whose time has come, of companies that exist and aren't promoted."""
    rows = queue.where("status = 'pending'")
    rows = rows if force else rows.where(F.col("scheduled_for") <= now)
    return rows.join(companies.where("current_status <> 'promoted'").select("company_id"), "company_id", "left_semi")


def marked_sent(queue: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """The queue with the given tokens sent; rows that are no longer pending stay."""
    hit = queue.join(sent.select("token").distinct().withColumn("_hit", F.lit(True)), "token", "left")
    now_sent = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "pending")
    return hit.withColumn("sent_at", F.when(now_sent, now).otherwise(F.col("sent_at"))).withColumn("status", F.when(now_sent, "sent").otherwise(F.col("status"))).drop("_hit").select(queue.columns)


def responded(queue: DataFrame, responses: DataFrame) -> DataFrame:
    """The queue with responses(token, responded_at) recorded; a second response to a token changes nothing."""
    first = responses.groupBy("token").agg(F.min("responded_at").alias("_at"))
    open_ = F.col("_at").isNotNull() & (F.col("status") != "responded")
    out = queue.join(first, "token", "left").withColumn("responded_at", F.when(open_, F.col("_at")).otherwise(F.col("responded_at")))
    return out.withColumn("status", F.when(open_, "responded").otherwise(F.col("status"))).drop("_at").select(queue.columns)


def opted_out(queue: DataFrame, companies: DataFrame) -> DataFrame:
    """The queue with all pending rows of the given companies closed."""
    hit = queue.join(companies.select("company_id").distinct().withColumn("_hit", F.lit(True)), "company_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "pending"), "opted_out").otherwise(F.col("status"))).drop("_hit").select(queue.columns)


def missed(queue: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """company_id, missed: sent more than some whole days ago without response."""
    old = (F.col("status") == "sent") & (F.timestamp_diff("DAY", F.col("sent_at"), now) > days)
    return queue.groupBy("company_id").agg(F.count_if(old).alias("missed"))


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def silent(companies: DataFrame, queue: DataFrame, probes: DataFrame, now: Column, age: int = 180, misses: int = 2) -> DataFrame:
    """Active companies that are old enough, missed enough follow-ups, and whose last probe found no site."""
    last = latest(probes, "company_id", [F.desc("probed_at"), F.desc("probe_id")]).select("company_id", "alive")
    rows = companies.where("current_status = 'active'").where(F.timestamp_diff("DAY", F.col("created_at"), now) >= age)
    return rows.join(missed(queue, now).where(F.col("missed") >= misses), "company_id").join(last.where("not alive"), "company_id", "left_semi").select("company_id", "missed")


def promotion_candidates(companies: DataFrame, snapshots: DataFrame, now: Column, age: int = 180, least: int = 2) -> DataFrame:
    """Active or silent companies that are old enough and have enough snapshots."""
    counts = snapshots.groupBy("company_id").agg(F.count("*").alias("snapshots"))
    rows = companies.where("current_status in ('active', 'silent')").where(F.timestamp_diff("DAY", F.col("created_at"), now) >= age)
    return rows.join(counts.where(F.col("snapshots") >= least), "company_id").select("company_id", "snapshots")


def promoted_status(status: Column) -> Column:
    """Corpus status of a promoted company."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s == "silent", "Inactive").when(s.contains("acqui"), "Acquired").when(s.rlike("|".join(lx.DEAD_MARKERS)), "Inactive").otherwise("Active")


def erase(companies: DataFrame, queue: DataFrame, nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies and queue without the given ids, and nodes with their names blanked; edges stay."""
    gone = ids.select("company_id").distinct()
    hit = nodes.join(gone.withColumn("_hit", F.lit(True)), "company_id", "left")
    nodes = hit.withColumn("name", F.when(F.col("_hit"), "[deleted]").otherwise(F.col("name"))).drop("_hit").select(nodes.columns)
    return companies.join(gone, "company_id", "left_anti"), queue.join(gone, "company_id", "left_anti"), nodes


def registered(companies: DataFrame, submissions: DataFrame, now: Column) -> DataFrame:
    """User companies with submissions merged in by (norm, email); an absent email is one value.

    A known company keeps its id, creation time and status and takes new consents; a new one gets an id from its key.
    """
    key = ["norm", "_email"]
    last = latest(submissions.withColumn("_email", F.coalesce("email", F.lit(""))).withColumn("_k", F.concat_ws("|", *key)), "_k", [F.desc("submitted_at")])
    old = companies.withColumn("_email", F.coalesce("email", F.lit("")))
    a, b = old.alias("a"), last.alias("b")
    joined = a.join(b, (F.col("a.norm") == F.col("b.norm")) & (F.col("a._email") == F.col("b._email")), "full_outer")
    return joined.select(
        F.coalesce("a.company_id", F.xxhash64("b.norm", "b._email")).alias("company_id"),
        F.coalesce("a.norm", "b.norm").alias("norm"),
        F.coalesce("a.email", "b.email").alias("email"),
        F.coalesce("b.consent_followup", "a.consent_followup").alias("consent_followup"),
        F.coalesce("a.created_at", now).alias("created_at"),
        F.when(F.col("b.norm").isNotNull(), now).otherwise(F.col("a.updated_at")).alias("updated_at"),
        F.coalesce("a.current_status", F.lit("active")).alias("current_status"),
    )


def promote(corpus: DataFrame, companies: DataFrame, snapshots: DataFrame, ids: DataFrame, source: str = "user") -> tuple[DataFrame, DataFrame]:
    """The corpus with the given companies added from their last snapshot, and the companies marked promoted.

    A company whose key the corpus has only adds its source there. corpus: norm, name, status, country, sources.
    """
    last = snapshots.groupBy("company_id").agg(F.max_by("input", "taken_at").alias("_in"))
    chosen = companies.join(ids.select("company_id").distinct(), "company_id", "left_semi").where("current_status <> 'promoted'").join(last, "company_id")
    new = chosen.groupBy("norm").agg(F.min_by(F.struct(F.col("_in.name").alias("name"), promoted_status(F.col("current_status")).alias("status"), F.col("_in.country").alias("country")), "company_id").alias("n"))
    a, b = corpus.alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.norm") == F.col("b.norm"), "full_outer")
    none = F.array().cast("array<string>")
    merged = joined.select(
        F.coalesce("a.norm", "b.norm").alias("norm"),
        *[F.when(F.col("a.norm").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.n.{c}")).alias(c) for c in ("name", "status", "country")],
        F.array_union(F.coalesce("a.sources", none), F.when(F.col("b.norm").isNotNull(), F.array(F.lit(source))).otherwise(none)).alias("sources"),
    )
    hit = companies.join(chosen.select("company_id", F.lit(True).alias("_hit")), "company_id", "left")
    return merged, hit.withColumn("current_status", F.when(F.col("_hit"), "promoted").otherwise(F.col("current_status"))).drop("_hit").select(companies.columns)


def probes_recorded(probes: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Probes with new answers (company_id, status_code, error) appended; a site is alive by its status code."""
    new = found.select("company_id", now.alias("probed_at"), "status_code", cl.probe_alive(F.col("status_code")).alias("alive"), "error")
    return probes.unionByName(new)


def dispatch_counts(queue: DataFrame, sent: DataFrame, companies: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """One row: due rows, those that were sent, and those left over."""
    rows = due(queue, companies, now, force).join(sent.select("token").distinct().withColumn("_sent", F.lit(True)), "token", "left")
    return rows.agg(F.count("*").alias("due"), F.count("_sent").alias("sent"), F.count_if(F.col("_sent").isNull()).alias("failed"))
