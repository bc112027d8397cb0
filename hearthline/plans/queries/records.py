"""Dedupe, merge, union, new-record and storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import jsontext, text, urls
from hearthline.operators import dedupe, merge, profile
from hearthline.plans.catalog import query
from hearthline.plans.tables import CLEAN_SQL, LISTINGS_SQL, clean_listings, listings, table
from hearthline.session import scratch_path
from hearthline.sources import listings as listing_source
from hearthline.sources import sinks

HASH_SQL = r"""
SELECT *, CASE WHEN norm IS NULL THEN '' ELSE substr(md5(norm), 1, 16) END AS h
FROM (SELECT *, nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '') AS norm FROM documents)"""


@query("description_hash", f"SELECT doc_id, h AS text_hash FROM ({HASH_SQL})")
def _hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.description_hash(F.col("text")).alias("text_hash"))


@query("dedupe_exact", f"""
SELECT doc_id, source, n_chars FROM ({HASH_SQL}) QUALIFY h = '' OR row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1""")
def _dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    slim = docs.withColumn("text_hash", text.description_hash(F.col("text"))).drop("text")
    return dedupe.keep_first(slim, ["text_hash"], ["doc_id"], F.col("text_hash") == "").drop("text_hash")


@query("dedupe_null_is_equal", f"""
SELECT listing_id, property_type FROM ({LISTINGS_SQL})
QUALIFY row_number() OVER (PARTITION BY property_type, governorate ORDER BY listing_id) = 1""")
def _dedupe_null(spark, sf):
    return dedupe.keep_first(listings(spark, sf).select("listing_id", "property_type", "governorate"),
                             ["property_type", "governorate"], ["listing_id"]).select("listing_id", "property_type")


@query("dedupe_composite", f"""
SELECT listing_id FROM ({CLEAN_SQL}) QUALIFY row_number() OVER (PARTITION BY governorate, round(price / 100000), living_area ORDER BY listing_id) = 1""")
def _composite(spark, sf):
    slim = clean_listings(spark, sf).select("listing_id", "governorate", F.round(F.col("price") / 100000).alias("band"), "living_area")
    return dedupe.keep_first(slim, ["governorate", "band", "living_area"], ["listing_id"]).select("listing_id")


@query("dedupe_by_url", """
WITH p AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS k FROM pages)
SELECT page_id, k AS url_key FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1""")
def _by_url(spark, sf):
    keyed = table(spark, sf, "pages").select("page_id", urls.normalize_strict(F.col("url")).alias("url_key"))
    return dedupe.keep_first(keyed, ["url_key"], ["page_id"])


@query("source_combine_stats", f"""
WITH f AS (SELECT source, h = '' OR row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS is_first FROM ({HASH_SQL}))
SELECT source, count(*) AS n_loaded, count(*) FILTER (is_first) AS n_kept, count(*) FILTER (NOT is_first) AS n_duplicates FROM f GROUP BY 1""")
def _source_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", text.description_hash(F.col("text")).alias("h"))
    return dedupe.combine_stats(docs, "source", "h", "doc_id", F.col("h") == "")


@query("union_sources", """
SELECT 'customer' AS data_source, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def _union(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return merge.union_sources({"customer": customer, "supplier": supplier})


KINDS = {"room_count": "number", "property_type": "text", "land_area": "zero_is_gap"}
PATCH_SQL = """SELECT event_id AS listing_id, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS room_count,
       event_type AS property_type, value AS land_area FROM events"""


def _patch(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))
    return events.select(F.col("event_id").alias("listing_id"), (F.col("k") % 7).alias("room_count"),
                         F.col("event_type").alias("property_type"), F.col("value").alias("land_area"))


@query("merge_fill", f"""
SELECT b.listing_id, coalesce(b.room_count, p.room_count) AS room_count, coalesce(b.property_type, p.property_type) AS property_type,
       CASE WHEN (b.land_area IS NULL OR b.land_area = 0) AND p.land_area IS NOT NULL THEN p.land_area ELSE b.land_area END AS land_area
FROM ({LISTINGS_SQL}) b LEFT JOIN ({PATCH_SQL}) p USING (listing_id)""")
def _merge(spark, sf):
    base = listings(spark, sf).select("listing_id", "room_count", "property_type", "land_area")
    return merge.merge_fill(base, _patch(spark, sf), "listing_id", KINDS)


@query("merge_preview", f"""
WITH j AS (SELECT b.listing_id, b.room_count AS br, b.property_type AS bt, b.land_area AS bl, p.room_count AS pr, p.property_type AS pt, p.land_area AS pl
           FROM ({LISTINGS_SQL}) b JOIN ({PATCH_SQL}) p USING (listing_id))
SELECT listing_id, 'room_count' AS column_name, CAST(br AS VARCHAR) AS before_value, CAST(pr AS VARCHAR) AS patch_value, CASE WHEN br IS NULL THEN 'new' ELSE 'keep' END AS status FROM j WHERE pr IS NOT NULL
UNION ALL SELECT listing_id, 'property_type', bt, pt, CASE WHEN bt IS NULL THEN 'new' ELSE 'keep' END FROM j WHERE pt IS NOT NULL
UNION ALL SELECT listing_id, 'land_area', CAST(bl AS VARCHAR), CAST(pl AS VARCHAR), CASE WHEN bl IS NULL THEN 'new' WHEN bl = 0 THEN 'replace' ELSE 'keep' END FROM j WHERE pl IS NOT NULL""")
def _preview(spark, sf):
    return merge.merge_preview(listings(spark, sf), _patch(spark, sf), "listing_id", KINDS)


@query("merge_counts", f"""
WITH j AS (SELECT b.room_count AS br, b.property_type AS bt, b.land_area AS bl, p.room_count AS pr, p.property_type AS pt, p.land_area AS pl
           FROM ({LISTINGS_SQL}) b JOIN ({PATCH_SQL}) p USING (listing_id))
SELECT 'room_count' AS column_name, count(*) FILTER (br IS NULL AND pr IS NOT NULL) AS n_updated FROM j
UNION ALL SELECT 'property_type', count(*) FILTER (bt IS NULL AND pt IS NOT NULL) FROM j
UNION ALL SELECT 'land_area', count(*) FILTER ((bl IS NULL OR bl = 0) AND pl IS NOT NULL) FROM j""")
def _merge_counts(spark, sf):
    return merge.merge_counts(listings(spark, sf), _patch(spark, sf), "listing_id", KINDS)


@query("json_from_text", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def _json(spark, sf):
    wrapped = F.concat(F.lit("Here is the answer:\n```json\n"), "props", F.lit("\n```\nand nothing {else"))
    found = table(spark, sf, "events").select("event_id", jsontext.json_in_text(wrapped).alias("j"))
    return found.select("event_id", F.from_json("j", "k int")["k"].alias("k"))


@query("answer_numbers", f"""
SELECT listing_id, TRY_CAST(nullif(raw_price, 'nan') AS DOUBLE) AS answer FROM ({LISTINGS_SQL})""")
def _answers(spark, sf):
    from hearthline.functions.numbers import answer_number

    raw = F.when(F.length("raw_price") > 3, F.concat(F.lit(" "), F.substring("raw_price", 1, 2), F.lit(","), F.expr("substring(raw_price, 3)"))).otherwise(F.col("raw_price"))
    return listings(spark, sf).select("listing_id", answer_number(raw).alias("answer"))


@query("new_urls", """
WITH d AS (SELECT url, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_key FROM pages)
SELECT url_key, min(url) AS url FROM d
WHERE url_key NOT IN (SELECT url_key FROM d WHERE url LIKE '%#top' OR url LIKE '%/') GROUP BY 1""")
def _new_urls(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    saved = pages.where(F.col("url").endswith("#top") | F.col("url").endswith("/")).select(F.lit("").alias("source_url"), "url")
    return merge.new_urls(pages, saved, "url", merge.first_filled(saved, ["source_url", "url", "listing_url"]))


@query("union_urls", """
SELECT DISTINCT url FROM (SELECT url FROM pages WHERE url LIKE 'http:%' UNION ALL SELECT url FROM pages)""")
def _union_urls(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    return pages.where(F.col("url").startswith("http:")).union(pages).distinct()


@query("read_write_records", f"""
SELECT 'listings' AS data_source, 'listings.json' AS source_file, count(*) AS n, count(price) AS n_priced, CAST(sum(TRY_CAST(nullif(price, 'nan') AS DOUBLE)) AS DOUBLE) AS price_sum
FROM (SELECT raw_price AS price FROM ({LISTINGS_SQL}))""")
def _roundtrip(spark, sf):
    path = scratch_path(spark, "records") + "/listings.json"
    sinks.write_records(listings(spark, sf).select(F.col("listing_id").alias("id"), F.col("raw_price").alias("price"), "governorate"), path)
    raw = listing_source.read_listings(spark, path, layout="lines")
    good, _ = listing_source.split_corrupt(raw)
    from hearthline.functions.numbers import clean_number

    return good.agg(F.count("*").alias("n"), F.count("price").alias("n_priced"), F.sum(clean_number(F.col("price"))).alias("price_sum")).select(
        F.lit("listings").alias("data_source"), F.lit("listings.json").alias("source_file"), "*")


@query("snapshot_table", f"SELECT '20240101' AS snapshot_ts, data_source, count(*) AS n FROM ({LISTINGS_SQL}) GROUP BY 2")
def _snapshot(spark, sf):
    path = scratch_path(spark, "snapshots")
    slim = listings(spark, sf).select("listing_id", "data_source")
    sinks.snapshot(slim, path, "20240101")
    sinks.snapshot(slim, path, "20240101")
    return spark.read.schema("listing_id long, data_source string, snapshot_ts string").parquet(path).groupBy("snapshot_ts", "data_source").agg(F.count("*").alias("n"))


@query("published_version", f"SELECT listing_id, raw_price FROM ({LISTINGS_SQL}) WHERE raw_price <> ''")
def _published(spark, sf):
    root = scratch_path(spark, "published")
    slim = listings(spark, sf).select("listing_id", "raw_price")
    sinks.publish(slim, root, "v1")
    sinks.publish(slim.where(F.col("raw_price") != ""), root, "v2")
    return sinks.read_published(spark, root)


@query("cleaning_report", f"""
SELECT count(*) AS rows_before, count(price) AS rows_after, count(*) || '>' || count(price) AS steps,
       round(100.0 * count(*) FILTER (living_area IS NULL) / count(*), 6) AS living_area_before, round(100.0 * count(*) FILTER (living_area IS NULL AND price IS NOT NULL) / count(price), 6) AS living_area_after,
       round(100.0 * count(*) FILTER (price IS NULL) / count(*), 6) AS price_before, 0.0::DOUBLE AS price_after FROM ({CLEAN_SQL})""")
def _report(spark, sf):
    raw = clean_listings(spark, sf)
    priced = raw.where(F.col("price").isNotNull())
    funnel = profile.removal_funnel(raw, [("price", F.col("price").isNotNull())])
    report = sinks.cleaning_report(raw, priced, funnel, ["price", "living_area"])
    steps = F.array_join(F.transform("steps", lambda s: s["n_left"].cast("string")), ">")
    share = lambda c, when: F.round(F.filter("null_shares", lambda s: s["column_name"] == c)[0][f"{when}_pct"], 6).alias(f"{c}_{when}")
    return report.select("rows_before", "rows_after", steps.alias("steps"), *(share(c, w) for c in ("price", "living_area") for w in ("before", "after")))


@query("feature_report", f"""
SELECT count(*) AS n_rows, count(*) FILTER (living_area IS NOT NULL AND room_count IS NOT NULL) AS n_complete, min(price) AS target_min,
       max(price) AS target_max, round(avg(price), 4) AS target_mean, 2 AS n_features FROM ({CLEAN_SQL}) WHERE price IS NOT NULL""")
def _feature_report(spark, sf):
    priced = clean_listings(spark, sf).where(F.col("price").isNotNull())
    return sinks.feature_report(priced, ["living_area", "room_count"], "price").drop("features").withColumn("target_mean", F.round("target_mean", 4))
