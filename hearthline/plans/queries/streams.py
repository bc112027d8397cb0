"""Task-log rollups and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions.dates import ntz_epoch_ms
from hearthline.functions.urls import normalize_strict
from hearthline.plans.catalog import query
from hearthline.plans.tables import table
from hearthline.session import scratch_path
from hearthline.sources.sinks import retain_since
from hearthline.streaming import ingest, rollup

ROLLUP_SQL = """
SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n_tasks, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END) AS BIGINT) AS total_new,
       min(CAST(event_type <> 'error' AS INT)) AS all_ok, round(sum(value), 2) AS total_seconds FROM events GROUP BY 1"""


def _log(df):
    """Events read as a task log: failures found nothing new."""
    found = F.from_json("props", "k int")["k"]
    return df.select("ts", "event_type", "value", F.when(F.col("event_type") != "error", found).alias("scraped_new"))


def _args():
    return F.col("ts"), F.col("scraped_new"), F.col("event_type") != "error", F.col("value")


def _shown(df):
    return df.withColumn("day", F.col("day").cast("string")).withColumn("total_seconds", F.round("total_seconds", 2))


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _utc(ts):
    """Watermarks need an instant; the zone-less event time is read as UTC."""
    return F.timestamp_millis(ntz_epoch_ms(ts))


def _append(stream, root):
    (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


@query("task_rollup", ROLLUP_SQL)
def _rollup(spark, sf):
    return _shown(rollup.daily_rollup(_log(table(spark, sf, "events")), *_args()))


@query("task_rollup_stream", ROLLUP_SQL)
def _rollup_stream(spark, sf):
    root = scratch_path(spark, "rollup")
    rollup.rollup_stream(_log(_stream(spark, sf, "events")), *_args(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _shown(rollup.read_rollup(spark, f"{root}/out"))


@query("task_rollup_windowed", ROLLUP_SQL)
def _rollup_windowed(spark, sf):
    root = scratch_path(spark, "windowed")
    log = _log(_stream(spark, sf, "events")).withColumn("ts", _utc(F.col("ts")))
    rollup.windowed_rollup_stream(log, "ts", *_args()[1:], f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _shown(spark.read.parquet(f"{root}/out"))


@query("bounded_dedupe_stream", "SELECT DISTINCT event_type || '/' || user_id AS url_key FROM events")
def _bounded(spark, sf):
    root = scratch_path(spark, "bounded")
    events = _stream(spark, sf, "events").select(_utc(F.col("ts")).alias("ts"), "event_type", "user_id")
    key = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    _append(ingest.dedupe_bounded(events, "ts", key, "40 days").select("url_key"), root)
    return spark.read.parquet(f"{root}/out")


URL_KEY_SQL = """'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')"""


def _landed(spark, sf, root, slices=4):
    """Pages as files that land one after another, by page_id; every seventh page has lost its URL. Returns the stream over them, a file a batch."""
    pages = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"))
    low, high, n = pages.agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()
    slices = max(slices, n // 1_000_000)  # a slice is one file
    edges = [low + (high + 1 - low) * i // slices for i in range(slices + 1)]
    for a, z in zip(edges, edges[1:]):
        pages.where((F.col("page_id") >= a) & (F.col("page_id") < z)).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    return spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")


@query("incremental_ingest_stream", f"""
SELECT min(page_id) AS page_id, {URL_KEY_SQL} AS url_key FROM pages WHERE page_id % 7 <> 0 GROUP BY 2
UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 7 = 0""")
def _ingest(spark, sf):
    """What was ingested over several micro-batches, and the quarantined rows."""
    root = scratch_path(spark, "ingest")
    ingest.ingest_new(_landed(spark, sf, root), "url", "page_id", f"{root}/out", f"{root}/checkpoint", normalize_strict).awaitTermination()
    bad = spark.read.parquet(ingest.quarantine_of(f"{root}/out")).select("page_id", F.lit(None).cast("string").alias("url_key"))
    return spark.read.parquet(f"{root}/out").select("page_id", "url_key").unionByName(bad)


@query("ingest_after_saved", f"""
WITH p AS (SELECT page_id, {URL_KEY_SQL} AS k FROM pages)
SELECT k AS url_key, min(page_id) AS page_id FROM p WHERE page_id % 7 <> 0 AND k NOT IN (SELECT k FROM p WHERE page_id % 3 = 0) GROUP BY 1""")
def _ingest_saved(spark, sf):
    """Ingest on top of a list saved earlier: its keys are the query's first state."""
    root = scratch_path(spark, "ingest-saved")
    saved = table(spark, sf, "pages").where("page_id % 3 = 0").select(normalize_strict(F.col("url")).alias("url_key"))
    ingest.ingest_new(_landed(spark, sf, root), "url", "page_id", f"{root}/out", f"{root}/checkpoint", known=saved).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("url_key", "page_id")


@query("log_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def _retention(spark, sf):
    return retain_since(table(spark, sf, "events"), F.col("ts"), F.lit("2024-01-31").cast("timestamp_ntz"), 10).select("event_id")


@query("pages_before_gap", """
WITH d AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS page, CAST(event_type <> 'error' AS INT) AS found FROM events),
p AS (SELECT user_id, page, CAST(sum(found) AS BIGINT) AS found FROM d GROUP BY 1, 2)
SELECT user_id, page, found FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.found = 0 AND q.page > 1 AND q.page <= p.page)""")
def _gap(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.from_json("props", "k int")["k"].alias("page"), (F.col("event_type") != "error").cast("int").alias("f"))
    pages = events.groupBy("user_id", "page").agg(F.sum("f").alias("found"))
    return rollup.pages_before_gap(pages, "user_id", "page", "found")


@query("crawl_counters", """
WITH c AS (SELECT event_type, count(*) AS n_pages, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS n_found, count(*) FILTER (value > 10) AS n_new FROM events GROUP BY 1)
SELECT *, greatest(0, n_new - n_pages // 2) AS growth FROM c""")
def _counters(spark, sf):
    k = F.from_json("props", "k int")["k"]
    counted = rollup.crawl_counters(table(spark, sf, "events"), "event_type", k, (F.col("value") > 10).cast("int"))
    return counted.withColumn("growth", rollup.growth(F.floor(F.col("n_pages") / 2), F.col("n_new")))
