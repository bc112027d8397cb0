"""Profiles, counts, histograms and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import profile, stats
from hearthline.plans.catalog import query
from hearthline.plans.tables import CLEAN_SQL, LISTINGS_SQL, clean_listings, listings, table

KEYS = ["price", "living_area", "room_count", "property_type"]


def _null_rows(cols, extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, "
        f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6) AS null_pct{extra} FROM c" for c in cols)


@query("null_profile", f"WITH c AS ({CLEAN_SQL}) {_null_rows(KEYS, ', count(*) AS n_rows')}")
def _null_profile(spark, sf):
    return profile.null_profile(clean_listings(spark, sf), KEYS).drop("data_type").withColumn("null_pct", F.round("null_pct", 6))


@query("enrichment_needs", f"""
WITH c AS ({CLEAN_SQL}), p AS ({_null_rows(['price', 'living_area', 'room_count'])})
SELECT column_name, TRUE AS present, null_count, null_pct, null_pct > 10 AS needs_extraction FROM p
UNION ALL SELECT 'heating', FALSE, count(*), 100.0, TRUE FROM c""")
def _needs(spark, sf):
    needs = profile.enrichment_needs(clean_listings(spark, sf), ["price", "living_area", "room_count", "heating"], 10.0)
    return needs.withColumn("null_pct", F.round("null_pct", 6))


@query("completeness_compare", f"""
WITH c AS ({CLEAN_SQL}), b AS ({_null_rows(KEYS)})
SELECT column_name, null_pct AS before_pct, null_count AS before_nulls,
       CASE WHEN column_name IN ('living_area', 'room_count') THEN 0.0 ELSE null_pct END AS after_pct,
       CASE WHEN column_name IN ('living_area', 'room_count') THEN 0 ELSE null_count END AS after_nulls,
       CASE WHEN column_name IN ('living_area', 'room_count') THEN null_pct ELSE 0.0 END AS improvement
FROM b""")
def _compare(spark, sf):
    before = clean_listings(spark, sf).select(*KEYS)
    after = stats.impute_median(before, ["living_area", "room_count"])
    compared = profile.compare_profiles(before, after)
    return compared.withColumns({c: F.round(c, 6) for c in ("before_pct", "after_pct", "improvement")})


@query("top_improvements", f"""
WITH c AS ({CLEAN_SQL}), b AS ({_null_rows(['living_area', 'room_count'])})
SELECT column_name, null_pct AS improvement FROM b ORDER BY 2 DESC, 1 LIMIT 1""")
def _top_improvements(spark, sf):
    before = clean_listings(spark, sf).select(*KEYS)
    after = stats.impute_median(before, ["living_area", "room_count"])
    return profile.top_improvements(before, after, n=1).select("column_name", F.round("improvement", 6).alias("improvement"))


@query("filled_cells", f"""
WITH c AS ({CLEAN_SQL}), n AS (SELECT count(*) AS n, count(price) + count(living_area) + count(room_count) + count(property_type) AS b,
       count(price) + 2 * count(*) + count(property_type) AS a FROM c)
SELECT b AS filled_before, a AS filled_after, round((a - b) * 100.0 / b, 6) AS gain_pct FROM n""")
def _filled(spark, sf):
    before = clean_listings(spark, sf).select(*KEYS)
    after = stats.impute_median(before, ["living_area", "room_count"])
    return profile.filled_cells(before, after, KEYS).withColumn("gain_pct", F.round("gain_pct", 6))


@query("null_patterns", f"""
SELECT CAST(price IS NULL AS INT) AS price, CAST(living_area IS NULL AS INT) AS living_area,
       CAST(room_count IS NULL AS INT) AS room_count, CAST(property_type IS NULL AS INT) AS property_type, count(*) AS n
FROM ({CLEAN_SQL}) GROUP BY 1, 2, 3, 4""")
def _patterns(spark, sf):
    return profile.null_patterns(clean_listings(spark, sf), KEYS)


@query("null_matrix", f"""
SELECT listing_id, CAST(price IS NULL AS INT) AS price, CAST(living_area IS NULL AS INT) AS living_area,
       CAST(room_count IS NULL AS INT) AS room_count, CAST(property_type IS NULL AS INT) AS property_type
FROM ({CLEAN_SQL}) ORDER BY listing_id LIMIT 100""")
def _matrix(spark, sf):
    return profile.null_matrix(clean_listings(spark, sf), "listing_id", KEYS)


@query("value_counts", f"SELECT property_type, count(*) AS n FROM ({LISTINGS_SQL}) WHERE property_type IS NOT NULL GROUP BY 1")
def _value_counts(spark, sf):
    return profile.value_counts(listings(spark, sf), "property_type")


@query("value_shares", f"""
SELECT property_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM ({LISTINGS_SQL}) WHERE property_type IS NOT NULL GROUP BY 1""")
def _value_shares(spark, sf):
    return profile.value_shares(listings(spark, sf), "property_type").withColumn("share_pct", F.round("share_pct", 6))


@query("top_categories", f"SELECT governorate, count(*) AS n FROM ({LISTINGS_SQL}) GROUP BY 1 ORDER BY n DESC, governorate LIMIT 8")
def _top(spark, sf):
    return profile.value_counts(listings(spark, sf), "governorate", 8)


def _summary_sql(by=""):
    select = "".join(f"{c}, " for c in by.split(",") if c)
    group = f"GROUP BY {by}" if by else ""
    one = lambda c: (
        f"SELECT {select}'{c}' AS column_name, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min_value, "
        f"CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 6) AS mean_value, CAST(median({c}) AS DOUBLE) AS median_value FROM c {group}")
    return f"WITH c AS ({CLEAN_SQL}) " + " UNION ALL ".join(one(c) for c in ("price", "living_area", "room_count"))


@query("numeric_summary", _summary_sql())
def _summary(spark, sf):
    return profile.numeric_summary(clean_listings(spark, sf), ["price", "living_area", "room_count"]).withColumn("mean_value", F.round("mean_value", 6))


@query("numeric_summary_by_source", _summary_sql("data_source"))
def _summary_by(spark, sf):
    df = profile.numeric_summary(clean_listings(spark, sf), ["price", "living_area", "room_count"], ["data_source"])
    return df.withColumn("mean_value", F.round("mean_value", 6))


@query("dirty_number_report", f"""
SELECT count(*) AS n_rows, 0::BIGINT AS n_null, count(*) FILTER (raw_price = 'nan') AS n_nan_text,
       count(*) FILTER (raw_price = '') AS n_blank, count(*) FILTER (raw_price = '0') AS n_zero,
       count(*) FILTER (raw_price NOT IN ('nan', '')) AS n_convertible, count(*) FILTER (raw_price IN ('nan', '')) AS n_bad
FROM ({LISTINGS_SQL})""")
def _dirty(spark, sf):
    return profile.dirty_numbers(listings(spark, sf), "raw_price")


@query("bad_number_sample", f"SELECT DISTINCT raw_price FROM ({LISTINGS_SQL}) WHERE raw_price IN ('nan', '')")
def _bad(spark, sf):
    return profile.bad_number_sample(listings(spark, sf), "raw_price")


@query("format_census", """
SELECT CASE WHEN props LIKE '[%' THEN 'list' WHEN props LIKE '{%' THEN 'object' ELSE 'text' END AS format, count(*) AS n
FROM (SELECT CASE event_type WHEN 'click' THEN '[' || props || ']' WHEN 'view' THEN event_type ELSE props END AS props FROM events)
GROUP BY 1""")
def _census(spark, sf):
    kind = F.col("event_type")
    mixed = F.when(kind == "click", F.concat(F.lit("["), "props", F.lit("]"))).when(kind == "view", kind).otherwise(F.col("props"))
    return profile.format_census(table(spark, sf, "events").select(mixed.alias("props")), "props")


@query("distinct_values", f"""
SELECT DISTINCT 'property_type' AS column_name, property_type AS value FROM ({LISTINGS_SQL}) WHERE property_type IS NOT NULL
UNION ALL SELECT DISTINCT 'governorate', governorate FROM ({LISTINGS_SQL})""")
def _distinct(spark, sf):
    return profile.distinct_values(listings(spark, sf), ["property_type", "governorate"])


@query("distinct_counts", f"""
SELECT 'property_type' AS column_name, count(DISTINCT property_type) AS n_distinct FROM ({LISTINGS_SQL})
UNION ALL SELECT 'raw_price', count(DISTINCT raw_price) FROM ({LISTINGS_SQL})""")
def _distinct_counts(spark, sf):
    return profile.distinct_counts(listings(spark, sf), ["property_type", "raw_price"])


@query("duplicate_count", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""")
def _duplicates(spark, sf):
    return profile.duplicate_count(table(spark, sf, "documents"), ["text", "lang"])


@query("nonzero_counts", f"""
SELECT 'land_area' AS column_name, count(land_area) AS n, count(*) FILTER (land_area <> 0) AS n_nonzero FROM ({LISTINGS_SQL})
UNION ALL SELECT 'room_count', count(room_count), count(*) FILTER (room_count <> 0) FROM ({LISTINGS_SQL})""")
def _nonzero(spark, sf):
    return profile.nonzero_counts(listings(spark, sf), ["land_area", "room_count"])


@query("score_distribution", """
SELECT avg(l_quantity) AS mean_score, min(l_quantity) AS min_score, max(l_quantity) AS max_score, count(*) FILTER (l_quantity > 7) AS n_high
FROM lineitem""")
def _scores(spark, sf):
    return profile.score_distribution(table(spark, sf, "lineitem"), "l_quantity")


@query("completeness", f"""
SELECT count(*) FILTER (price IS NOT NULL AND living_area IS NOT NULL AND room_count IS NOT NULL AND property_type IS NOT NULL) AS n_complete,
       count(*) AS n_rows,
       round(count(*) FILTER (price IS NOT NULL AND living_area IS NOT NULL AND room_count IS NOT NULL AND property_type IS NOT NULL) * 100.0 / count(*), 6) AS complete_pct
FROM ({CLEAN_SQL})""")
def _completeness(spark, sf):
    return profile.completeness(clean_listings(spark, sf), KEYS).withColumn("complete_pct", F.round("complete_pct", 6))


@query("price_histogram", f"""
WITH c AS (SELECT price FROM ({CLEAN_SQL}) WHERE price IS NOT NULL),
m AS (SELECT min(price) AS lo, max(price) AS hi, (max(price) - min(price)) / 30 AS w FROM c),
b AS (SELECT least(CAST(floor((price - lo) / w) AS INT), 29) AS bin, count(*) AS n FROM c, m GROUP BY 1)
SELECT CAST(r.i AS INT) AS bin, round(lo + r.i * w, 4) AS bin_start, round(lo + (r.i + 1) * w, 4) AS bin_end, coalesce(n, 0) AS n
FROM range(30) r(i) CROSS JOIN m LEFT JOIN b ON b.bin = r.i""")
def _histogram(spark, sf):
    bins = profile.histogram(clean_listings(spark, sf), "price", 30)
    return bins.withColumns({c: F.round(c, 4) for c in ("bin_start", "bin_end")})


@query("box_stats", f"""
WITH c AS (SELECT property_type, price FROM ({CLEAN_SQL}) WHERE price IS NOT NULL),
q AS (SELECT property_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median_value, quantile_cont(price, 0.75) AS q3 FROM c GROUP BY 1),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)
SELECT b.property_type, round(q1, 4) AS q1, round(median_value, 4) AS median_value, round(q3, 4) AS q3, round(lower_bound, 4) AS lower_bound,
       round(upper_bound, 4) AS upper_bound, count(*) AS n, min(price) FILTER (price BETWEEN lower_bound AND upper_bound) AS whisker_low,
       max(price) FILTER (price BETWEEN lower_bound AND upper_bound) AS whisker_high,
       count(*) FILTER (price NOT BETWEEN lower_bound AND upper_bound) AS n_outliers
FROM c JOIN b ON c.property_type IS NOT DISTINCT FROM b.property_type
GROUP BY b.property_type, q1, median_value, q3, lower_bound, upper_bound""")
def _box(spark, sf):
    box = profile.box_stats(clean_listings(spark, sf), "price", ["property_type"])
    return box.withColumns({c: F.round(c, 4) for c in ("q1", "median_value", "q3", "lower_bound", "upper_bound")})


@query("table_row_counts", """
SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events""")
def _row_counts(spark, sf):
    from functools import reduce

    counts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("orders", "documents", "pages", "events")]
    return reduce(lambda a, b: a.unionByName(b), counts)
