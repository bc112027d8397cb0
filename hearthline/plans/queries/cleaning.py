"""Cleaning, filtering and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import constants as K
from hearthline.functions import numbers
from hearthline.operators import columns, filters, profile
from hearthline.plans.catalog import query
from hearthline.plans.prepare import segment_summary
from hearthline.plans.tables import CLEAN_SQL, LISTINGS_SQL, clean_listings, described_listings, listings, table
from hearthline.schemas import LISTING_SCHEMA

SEGMENT_CASE = """CASE WHEN price < 100000 THEN 'Budget' WHEN price < 200000 THEN 'Entry-Level'
    WHEN price < 400000 THEN 'Mid-Market' WHEN price < 800000 THEN 'Upper-Mid' ELSE 'Luxury' END"""


@query("segment_summary", f"""
SELECT governorate, {SEGMENT_CASE} AS market_segment, count(*) AS n_listings, avg(price) AS avg_price,
       round(avg(price / nullif(living_area, 0)), 4) AS avg_price_per_sqm
FROM ({CLEAN_SQL})
WHERE price IS NOT NULL AND property_type IS NOT NULL
GROUP BY ALL""")
def _segment_summary(spark, sf):
    return segment_summary(clean_listings(spark, sf))


@query("clean_price", f"SELECT listing_id, price FROM ({CLEAN_SQL})")
def _clean_price(spark, sf):
    return clean_listings(spark, sf).select("listing_id", "price")


@query("clean_numeric", f"""
SELECT listing_id, TRY_CAST(nullif(raw_price, 'nan') AS DOUBLE) AS as_number,
       coalesce(TRY_CAST(nullif(raw_price, 'nan') AS DOUBLE), 0.0) AS as_float,
       coalesce(CAST(trunc(TRY_CAST(nullif(raw_price, 'nan') AS DOUBLE) / 7) AS BIGINT), -1) AS as_int
FROM ({LISTINGS_SQL})""")
def _clean_numeric(spark, sf):
    raw = F.col("raw_price")
    seventh = (numbers.clean_number(raw) / 7).cast("string")
    return listings(spark, sf).select("listing_id", numbers.clean_number(raw).alias("as_number"),
                                      numbers.safe_float(raw).alias("as_float"), numbers.safe_int(seventh, -1).alias("as_int"))


@query("digits_from_text", f"""
WITH t AS (SELECT listing_id, raw_price || ',5 m2' AS txt, CAST(living_area AS INT) || '.5 m2' AS area FROM ({LISTINGS_SQL}))
SELECT listing_id, TRY_CAST(nullif(regexp_replace(txt, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits,
       CAST(trunc(TRY_CAST(nullif(replace(regexp_replace(txt, '[^0-9.,]', '', 'g'), ',', ''), '') AS DOUBLE)) AS BIGINT) AS decimal_digits,
       TRY_CAST(nullif(regexp_extract(area, '[0-9]+'), '') AS INT) AS first_int,
       TRY_CAST(nullif(regexp_extract(area, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) AS first_number
FROM t""")
def _digits_from_text(spark, sf):
    text = F.concat("raw_price", F.lit(",5 m2"))
    area = F.concat(F.col("living_area").cast("int").cast("string"), F.lit(".5 m2"))
    return listings(spark, sf).select(
        "listing_id", numbers.digits_to_int(text).alias("digits"), numbers.decimal_to_int(text).alias("decimal_digits"),
        numbers.first_int(area).alias("first_int"), numbers.first_number(area).alias("first_number"))


@query("drop_missing_target", f"SELECT listing_id, price, property_type FROM ({CLEAN_SQL}) WHERE price IS NOT NULL AND property_type IS NOT NULL")
def _drop_missing(spark, sf):
    return filters.drop_missing(clean_listings(spark, sf), "price", "property_type").select("listing_id", "price", "property_type")


@query("exclude_categories", f"""
SELECT listing_id, property_type FROM ({LISTINGS_SQL})
WHERE property_type IS NOT NULL AND property_type NOT IN ('MACHINERY', 'FURNITURE')""")
def _exclude(spark, sf):
    return filters.exclude_categories(listings(spark, sf), "property_type", ["MACHINERY", "FURNITURE"]).select("listing_id", "property_type")


@query("drop_empty_text", f"SELECT listing_id, raw_price FROM ({LISTINGS_SQL}) WHERE raw_price <> ''")
def _drop_empty(spark, sf):
    return filters.drop_empty_text(listings(spark, sf), "raw_price").select("listing_id", "raw_price")


@query("price_floor", f"SELECT listing_id, price FROM ({CLEAN_SQL}) WHERE price > 1000")
def _price_floor(spark, sf):
    return filters.price_above(clean_listings(spark, sf)).select("listing_id", "price")


@query("plausible_ranges", f"""
SELECT listing_id, price, living_area FROM ({CLEAN_SQL})
WHERE price BETWEEN 10000 AND 10000000 AND living_area BETWEEN 10 AND 2000""")
def _ranges(spark, sf):
    limits = {"price": K.DOCUMENTED_PRICE_RANGE, "living_area": K.DOCUMENTED_AREA_RANGE}
    return filters.within(clean_listings(spark, sf), limits).select("listing_id", "price", "living_area")


@query("removal_funnel", f"""
WITH c AS ({CLEAN_SQL}), s AS (
SELECT count(*) AS s0, count(*) FILTER (price IS NOT NULL) AS s1,
       count(*) FILTER (price IS NOT NULL AND property_type IS NOT NULL) AS s2,
       count(*) FILTER (price IS NOT NULL AND property_type IS NOT NULL AND living_area >= 50) AS s3 FROM c)
SELECT 0 AS step, 'Initial' AS rule, s0 AS n_left FROM s
UNION ALL SELECT 1, 'price', s1 FROM s UNION ALL SELECT 2, 'property_type', s2 FROM s
UNION ALL SELECT 3, 'living_area', s3 FROM s""")
def _funnel(spark, sf):
    return profile.removal_funnel(clean_listings(spark, sf), [
        ("price", F.col("price").isNotNull()), ("property_type", F.col("property_type").isNotNull()),
        ("living_area", F.col("living_area") >= 50)])


@query("enrichment_worklist", f"""
SELECT l.listing_id FROM ({CLEAN_SQL}) l
JOIN documents d ON d.doc_id = l.listing_id % (SELECT count(*) FROM documents)
WHERE d.text IS NOT NULL AND d.text <> '' AND (living_area IS NULL OR room_count IS NULL OR property_type IS NULL)""")
def _worklist(spark, sf):
    described = described_listings(spark, sf)
    return filters.needs_enrichment(described, ["living_area", "room_count", "property_type"]).select("listing_id")


@query("request_texts", """
SELECT doc_id, 'Extract the fields.' || chr(10) || 'Description: ' || coalesce(text, '') || chr(10) || 'Address: ' || coalesce(source, '') AS request
FROM documents WHERE trim(coalesce(text, '')) <> '' OR trim(coalesce(source, '')) <> ''""")
def _requests(spark, sf):
    return filters.request_texts(table(spark, sf, "documents"), "doc_id", "Extract the fields.", "text", "source")


@query("request_cost", f"""
SELECT count(*) AS n_requests, count(*) * 800 AS n_tokens, round(count(*) * 800 / 1000.0 * 0.0001, 6) AS cost
FROM ({CLEAN_SQL}) WHERE living_area IS NULL OR room_count IS NULL""")
def _cost(spark, sf):
    work = clean_listings(spark, sf).where(F.col("living_area").isNull() | F.col("room_count").isNull())
    return profile.token_cost(work).withColumn("cost", F.round("cost", 6))


@query("url_check", """
WITH t AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS short, lower(regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS lang FROM pages)
SELECT page_id, 'https://' || short AS full_url,
       CASE lang WHEN 'en' THEN contains('https://' || short, 'example.com') WHEN 'fr' THEN contains('https://' || short, 'example.org')
                 WHEN 'de' THEN TRUE ELSE FALSE END AS url_ok
FROM t""")
def _url_check(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://", "").alias("short"),
        F.lower(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("lang"))
    checked = filters.url_check(pages, "short", "lang", {"en": "example.com", "fr": "example.org", "de": ""})
    return checked.select("page_id", "full_url", "url_ok")


@query("invalid_values", f"""
SELECT listing_id, 'property_type' AS column_name, property_type AS value FROM ({LISTINGS_SQL})
WHERE property_type IS NOT NULL AND property_type NOT IN ('BUILDING', 'HOUSEHOLD')
UNION ALL SELECT listing_id, 'data_source', data_source FROM ({LISTINGS_SQL}) WHERE data_source NOT IN ('O', 'F')""")
def _invalid(spark, sf):
    domains = {"property_type": ["BUILDING", "HOUSEHOLD"], "data_source": ["O", "F"]}
    return filters.invalid_values(listings(spark, sf), "listing_id", domains)


@query("form_records", f"""
SELECT listing_id, CASE WHEN raw_price = '' THEN 'nan' ELSE raw_price END AS price,
       CASE WHEN living_area IS NULL THEN 'nan' ELSE CAST(CAST(living_area AS INT) AS VARCHAR) END AS living_area,
       governorate, CAST(room_count AS INT) AS room_count, CAST(NULL AS INT) AS land_area
FROM ({LISTINGS_SQL})""")
def _form(spark, sf):
    raw = listings(spark, sf).select(
        F.col("listing_id").cast("string").alias("address"), F.col("raw_price").alias("price"), "governorate", "property_type",
        F.col("living_area").cast("int").cast("string").alias("living_area"), F.col("room_count").cast("string").alias("room_count"),
        F.col("land_area").cast("string").alias("land_area"),
        *[F.lit(None).cast("string").alias(c) for c in ("delegation", "locality", "condition", "description", "bathroom_count", "construction_year", "floor")])
    return columns.form_record(raw).select(
        F.col("address").cast("bigint").alias("listing_id"), "price", "living_area", "governorate", "room_count", "land_area")


_PRESENT = {"id": "CAST(listing_id AS VARCHAR)", **{c: c for c in ("price", "living_area", "land_area", "room_count", "bathroom_count", "governorate", "property_type")}}
_SQL_TYPES = {"double": "DOUBLE", "int": "INT", "boolean": "BOOLEAN", "bigint": "BIGINT", "string": "VARCHAR"}


def _conformed_sql(f):
    """A column of the listing schema; arrays are shown as text."""
    kind = f.dataType.simpleString()
    value = "''" if kind.startswith("array") else _PRESENT.get(f.name, "NULL")
    return f"CAST({value} AS {_SQL_TYPES.get(kind, 'VARCHAR')}) AS {f.name}"


@query("conform_schema", f"SELECT {', '.join(map(_conformed_sql, LISTING_SCHEMA.fields))} FROM ({CLEAN_SQL})")
def _conform(spark, sf):
    shaped = columns.conform(clean_listings(spark, sf).withColumn("id", F.col("listing_id").cast("string")), LISTING_SCHEMA)
    return shaped.withColumns({f.name: F.array_join(f.name, "|") for f in LISTING_SCHEMA.fields if f.dataType.simpleString().startswith("array")})


@query("add_missing_features", f"""
SELECT listing_id, room_count, '' AS address, CAST(NULL AS DOUBLE) AS quality_score, 0 AS sea_view FROM ({LISTINGS_SQL})""")
def _add_missing(spark, sf):
    return columns.add_missing_features(listings(spark, sf)).select("listing_id", "room_count", "address", "quality_score", "sea_view")


@query("align_features", f"""
SELECT listing_id, coalesce(CAST(room_count AS DOUBLE), 0.0) AS room_count, 0.0::DOUBLE AS has_pool, coalesce(living_area, 0.0) AS living_area
FROM ({LISTINGS_SQL})""")
def _align(spark, sf):
    return columns.align_features(listings(spark, sf), ["room_count", "has_pool", "living_area"], ["listing_id"])


@query("required_columns", f"SELECT listing_id, raw_price FROM ({LISTINGS_SQL})")
def _required(spark, sf):
    return columns.require_columns(listings(spark, sf), ["listing_id", "raw_price"]).select("listing_id", "raw_price")


@query("column_kinds", f"""
WITH l AS ({LISTINGS_SQL})
SELECT 'room_count' AS column_name, count(DISTINCT room_count) AS n_distinct, 'categorical' AS kind FROM l
UNION ALL SELECT 'bathroom_count', count(DISTINCT bathroom_count), 'categorical' FROM l
UNION ALL SELECT 'living_area', count(DISTINCT living_area), 'numeric' FROM l
UNION ALL SELECT 'property_type', count(DISTINCT property_type), 'categorical' FROM l
UNION ALL SELECT 'is_odd', count(DISTINCT listing_id % 2), 'binary' FROM l""")
def _kinds(spark, sf):
    df = listings(spark, sf).withColumn("is_odd", F.col("listing_id") % 2)
    return profile.column_kinds(df, ["room_count", "bathroom_count", "living_area", "property_type", "is_odd"])


@query("drop_columns_complete_rows", f"""
SELECT listing_id, price, living_area, room_count FROM ({CLEAN_SQL})
WHERE price IS NOT NULL AND living_area IS NOT NULL AND room_count IS NOT NULL""")
def _complete_rows(spark, sf):
    df = clean_listings(spark, sf).drop("governorate", "property_type", "data_source", "not_there")
    return df.select("listing_id", "price", "living_area", "room_count").na.drop()
