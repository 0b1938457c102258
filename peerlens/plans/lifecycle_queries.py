"""Queries over events, conversations and pages: follow-ups, probes, windows, streams and HTML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.operators import lifecycle
from peerlens.sources import html
from peerlens.streaming import events as ev
from peerlens.streaming import followups

from .registry import load, query

NOW = "2024-12-31 00:00:00"

REG = """reg AS (SELECT user_id AS company_id, min(ts) AS created_at FROM events WHERE event_type = 'signup' GROUP BY user_id),
uc AS (SELECT company_id, created_at, CASE WHEN company_id % 4 = 0 THEN '' ELSE 'u' || company_id || '@example.org' END AS email, company_id % 7 <> 0 AS consent_followup, CASE WHEN company_id % 11 = 0 THEN 'promoted' ELSE 'active' END AS current_status FROM reg),
qu AS (SELECT company_id, email, d AS days_offset, created_at + to_days(d) AS scheduled_for FROM uc, (VALUES (90), (180), (365), (730)) v(d) WHERE consent_followup AND email <> '')"""


def _companies(spark, sf_dir):
    reg = load(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("company_id")).agg(F.min("ts").alias("created_at"))
    return reg.select(
        "company_id",
        "created_at",
        F.when(F.col("company_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), "company_id", F.lit("@example.org"))).alias("email"),
        (F.col("company_id") % 7 != 0).alias("consent_followup"),
        F.when(F.col("company_id") % 11 == 0, "promoted").otherwise("active").alias("current_status"),
    )


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {REG} SELECT company_id, email, days_offset, scheduled_for, 'pending' AS status FROM qu")
def followup_schedule(spark, sf_dir):
    return lifecycle.schedule(_companies(spark, sf_dir))


@query(f"WITH {REG} SELECT company_id, days_offset FROM qu WHERE scheduled_for <= TIMESTAMP '{NOW}' AND company_id IN (SELECT company_id FROM uc WHERE current_status <> 'promoted')")
def followup_due(spark, sf_dir):
    c = _companies(spark, sf_dir)
    return lifecycle.due(lifecycle.schedule(c), c, _now()).select("company_id", "days_offset")


QUEUE = """fq AS (SELECT event_id AS token, user_id AS company_id, ts AS sent_at, CASE WHEN event_id % 3 = 0 THEN 'responded' ELSE 'sent' END AS status FROM events WHERE event_type IN ('view', 'click'))"""


def _queue(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    return e.select(F.col("event_id").alias("token"), F.col("user_id").alias("company_id"), F.col("ts").alias("sent_at"), F.lit(None).cast("timestamp_ntz").alias("responded_at"), F.when(F.col("event_id") % 3 == 0, "responded").otherwise("sent").alias("status"))


@query(f"""
WITH {QUEUE}, r AS (SELECT event_id - 1 AS token, min(ts) AS answered FROM events WHERE event_type = 'purchase' GROUP BY event_id)
SELECT token, company_id, CASE WHEN answered IS NOT NULL AND status <> 'responded' THEN answered END AS responded_at, CASE WHEN answered IS NOT NULL THEN 'responded' ELSE status END AS status FROM fq LEFT JOIN r USING (token)
""")
def followup_respond(spark, sf_dir):
    answers = load(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("token"), F.col("ts").alias("responded_at"))
    return lifecycle.responded(_queue(spark, sf_dir), answers).select("token", "company_id", "responded_at", "status")


@query(f"""
WITH {REG}, {QUEUE}, m AS (SELECT company_id, count(*) FILTER (status = 'sent' AND floor(epoch(TIMESTAMP '{NOW}' - sent_at) / 86400) > 30) AS missed FROM fq GROUP BY company_id),
p AS (SELECT user_id AS company_id, arg_max(event_type, (ts, event_id)) <> 'error' AS alive FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id)
SELECT company_id, missed FROM uc JOIN m USING (company_id) JOIN p USING (company_id) WHERE current_status = 'active' AND missed >= 2 AND NOT alive AND floor(epoch(TIMESTAMP '{NOW}' - created_at) / 86400) >= 180
""")
def silent_death(spark, sf_dir):
    probes = load(spark, sf_dir, "events").where("event_type in ('error', 'view')").select(F.col("user_id").alias("company_id"), F.col("ts").alias("probed_at"), F.col("event_id").alias("probe_id"), (F.col("event_type") != "error").alias("alive"))
    return lifecycle.silent(_companies(spark, sf_dir), _queue(spark, sf_dir), probes, _now())


@query(f"""
WITH {REG}, s AS (SELECT user_id AS company_id, count(*) AS snapshots FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id)
SELECT company_id, snapshots FROM uc JOIN s USING (company_id) WHERE current_status IN ('active', 'silent') AND snapshots >= 2 AND floor(epoch(TIMESTAMP '{NOW}' - created_at) / 86400) >= 180
""")
def promotion_candidates(spark, sf_dir):
    snapshots = load(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("company_id"))
    return lifecycle.promotion_candidates(_companies(spark, sf_dir), snapshots, _now())


@query(f"""
WITH {REG} SELECT 'company' AS kind, company_id, email AS value FROM uc WHERE company_id % 5 <> 0
UNION ALL SELECT 'node', company_id, CASE WHEN company_id % 5 = 0 THEN '[deleted]' ELSE 'n' || company_id END FROM uc
""")
def erasure_anonymise(spark, sf_dir):
    c = _companies(spark, sf_dir)
    nodes = c.select("company_id", F.concat(F.lit("n"), "company_id").alias("name"))
    left, _, blanked = lifecycle.erase(c, lifecycle.schedule(c), nodes, c.where("company_id % 5 = 0").select("company_id"))
    return left.select(F.lit("company").alias("kind"), "company_id", F.col("email").alias("value")).unionByName(blanked.select(F.lit("node").alias("kind"), "company_id", F.col("name").alias("value")))


@query(f"WITH {REG} SELECT current_status, count(*) AS companies, count(*) FILTER (consent_followup) AS with_consent, count(*) FILTER (email = '') AS without_email FROM uc GROUP BY current_status")
def lifecycle_stats(spark, sf_dir):
    return _companies(spark, sf_dir).groupBy("current_status").agg(F.count("*").alias("companies"), F.count_if("consent_followup").alias("with_consent"), F.count_if(F.col("email") == "").alias("without_email"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS value FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return ev.windowed_counts(load(spark, sf_dir, "events"), "1 day").select("window_start", "event_type", "n", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"))


@query("""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS window_start, event_type FROM events)
SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL
""")
def events_sliding(spark, sf_dir):
    return ev.windowed_counts(load(spark, sf_dir, "events"), "2 days", "1 day").select("window_start", "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def events_session(spark, sf_dir):
    return ev.sessions(load(spark, sf_dir, "events"), "12 hours")


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
l AS (SELECT user_id, max(run) AS last FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'prospect' WHEN count(*) FILTER (event_type = 'error' AND run = last) >= 2 THEN 'silent' ELSE 'active' END AS status,
  count(*) FILTER (event_type IN ('signup', 'purchase'))::INT AS snapshots, count(*) FILTER (event_type = 'error' AND run = last)::INT AS errors
FROM e JOIN l USING (user_id) GROUP BY user_id
""")
def events_stateful_stream(spark, sf_dir):
    """The lifecycle state machine as a stream over the table's files, run to the end of what is there."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    name, at = f"lifecycle_{uuid.uuid4().hex}", f"{folder}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # files of a table: a folder of Parquet files, or one file named by a pattern in its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")

    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    run = ev.lifecycle_stream(stream).writeStream.queryName(name).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return lifecycle.latest(out, "user_id", [F.desc("_batch")]).select("user_id", "status", "snapshots", "errors")


@query("""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t FROM events), now AS (SELECT max(t) - 86400000 AS now FROM e),
r AS (SELECT user_id, min(t) AS reg FROM e WHERE event_type = 'signup' GROUP BY user_id),
d AS (SELECT user_id, o, reg + o * 86400000 AS due, reg + (o + 1) * 86400000 AS ends FROM r, (VALUES (1::BIGINT), (2), (4), (8), (60)) v(o)),
m AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = d.user_id AND event_type = 'purchase' AND t > due AND t <= ends)),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ends) AS missed, (SELECT arg_max(event_type, (t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) FROM e WHERE e.user_id = m.user_id AND event_type IN ('click', 'error') AND t <= ends) AS last FROM m),
s AS (SELECT user_id, min(ends) AS t0, arg_min(o, ends) AS o FROM n WHERE missed >= 2 AND last = 'error' GROUP BY user_id),
all_events AS (SELECT user_id AS company_id, due AS t0, 'due' AS event, o FROM d UNION ALL SELECT user_id, ends, 'missed', o FROM m UNION ALL SELECT user_id, t0, 'silent', o FROM s)
SELECT company_id, make_timestamp(t0 * 1000) AS "at", event, o::INTEGER AS "offset" FROM all_events, now WHERE t0 <= now
""")
def followup_timers(spark, sf_dir):
    """Follow-ups due, missed and companies gone silent, by timers over the stream of events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "registered", "purchase": "answered", "click": "alive", "error": "dead"}.items() for x in kv])
    events = stream.select(F.col("user_id").alias("company_id"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("other")).alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    made = followups.run(followups.follow_ups(events, [1, 2, 4, 8, 60], 1, 2))
    return made.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, sf_dir):
    return html.links(load(spark, sf_dir, "pages"))


@query()
def html_sections(spark, sf_dir):
    return html.sections(load(spark, sf_dir, "pages"))


@query("""SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def html_profile(spark, sf_dir):
    return html.profile(load(spark, sf_dir, "pages"))
