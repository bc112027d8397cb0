"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import constants as K
from hearthline.functions import scores
from hearthline.operators import features, stats
from hearthline.plans.catalog import query
from hearthline.plans.tables import CLEAN_SQL, LISTINGS_SQL, clean_listings, described_listings, listings, table

MAJOR = ["NATION_0", "NATION_3", "NATION_7"]
COAST = ["NATION_3", "NATION_5", "NATION_9", "NATION_11"]
_in = lambda c, vs: f"CAST({c} IN ({', '.join(repr(v) for v in vs)}) AS INT)"

RATIO_COLS = """price / living_area AS price_per_sqm, coalesce(living_area, 0) + coalesce(land_area, 0) AS total_area,
       living_area / nullif(land_area, 0) AS living_to_land_ratio, living_area / nullif(room_count, 0) AS avg_room_size,
       bathroom_count / nullif(CAST(room_count AS DOUBLE), 0) AS bathroom_room_ratio"""
LOCATED_SQL = f"""SELECT *, {RATIO_COLS}, {_in('governorate', MAJOR)} AS is_major_city, {_in('governorate', COAST)} AS is_coastal,
       CAST(listing_id % 6 AS INT) AS luxury_score FROM ({CLEAN_SQL})"""
SCORE_SQL = """least(15, CASE WHEN living_area > 200 THEN 3 WHEN living_area > 100 THEN 2 WHEN living_area > 50 THEN 1 ELSE 0 END
       + least(luxury_score, 5) + 2 * is_major_city + is_coastal
       + CASE WHEN avg_room_size > 25 THEN 2 WHEN avg_room_size > 15 THEN 1 ELSE 0 END)"""
SCORED_SQL = f"SELECT *, {SCORE_SQL} AS score FROM ({LOCATED_SQL})"
TIERED_SQL = f"""SELECT *, CASE WHEN score >= 12 OR luxury_score >= 4 THEN 'Premium' WHEN score >= 8 OR luxury_score >= 2 THEN 'Standard'
       WHEN score >= 5 THEN 'Basic' ELSE 'Economy' END AS tier FROM ({SCORED_SQL})"""


def _located(spark, sf):
    sized = features.size_features(clean_listings(spark, sf))
    return sized.withColumns({
        "is_major_city": F.col("governorate").isin(MAJOR).cast("int"), "is_coastal": F.col("governorate").isin(COAST).cast("int"),
        "luxury_score": (F.col("listing_id") % 6).cast("int"),
    })


def _scored(spark, sf):
    return _located(spark, sf).withColumn("score", scores.property_score(
        F.col("living_area"), F.col("luxury_score"), F.col("is_major_city"), F.col("is_coastal"), F.col("avg_room_size")))


def _tiered(spark, sf):
    return _scored(spark, sf).withColumn("tier", scores.tier_by_score(F.col("score"), F.col("luxury_score")))


@query("size_ratios", f"""
SELECT listing_id, round(price / living_area, 6) AS price_per_sqm, coalesce(living_area, 0) + coalesce(land_area, 0) AS total_area,
       round(living_area / nullif(land_area, 0), 6) AS living_to_land_ratio, round(living_area / nullif(room_count, 0), 6) AS avg_room_size,
       round(bathroom_count / nullif(CAST(room_count AS DOUBLE), 0), 6) AS bathroom_room_ratio,
       round((coalesce(living_area, 0) + coalesce(land_area, 0)) / nullif(room_count, 0), 6) AS area_per_room,
       round(price / nullif(room_count, 0), 6) AS price_per_room FROM ({CLEAN_SQL})""")
def _ratios(spark, sf):
    df = features.size_features(clean_listings(spark, sf))
    rounded = ["price_per_sqm", "living_to_land_ratio", "avg_room_size", "bathroom_room_ratio", "area_per_room", "price_per_room"]
    return df.select("listing_id", "total_area", *[F.round(c, 6).alias(c) for c in rounded])


@query("serve_ratios", f"""
WITH s AS (SELECT listing_id, coalesce(price, 0) AS p, coalesce(living_area, 0) AS l, coalesce(land_area, 0) AS d, coalesce(room_count, 0) AS r, bathroom_count AS b FROM ({CLEAN_SQL}))
SELECT listing_id, round(CASE WHEN l > 0 AND p > 0 THEN p / greatest(l, 1) ELSE 0 END, 6) AS price_per_sqm,
       round(CASE WHEN d > 0 THEN l / greatest(d, 1) ELSE l END, 6) AS living_to_land_ratio, round(CASE WHEN r > 0 THEN l / r ELSE l END, 6) AS avg_room_size,
       round(CASE WHEN r > 0 THEN b / CAST(r AS DOUBLE) ELSE 0 END, 6) AS bathroom_room_ratio FROM s""")
def _serve_ratios(spark, sf):
    df = clean_listings(spark, sf).na.fill(0, ["price", "living_area", "land_area", "room_count"])
    ratios = scores.serve_ratios(*[F.col(c) for c in ("price", "living_area", "land_area", "room_count", "bathroom_count")])
    return df.select("listing_id", *[F.round(v, 6).alias(c) for c, v in ratios.items() if c != "total_area"])


@query("location_flags", f"""
SELECT listing_id, 'Nation' || substr(governorate, 7) AS governorate_clean, {_in('governorate', MAJOR)} AS is_major_city, {_in('governorate', COAST)} AS is_coastal
FROM ({LISTINGS_SQL})""")
def _location(spark, sf):
    title = [[n.replace("NATION", "Nation") for n in names] for names in (MAJOR, COAST)]
    df = features.location_features(listings(spark, sf), major=title[0], coastal=title[1])
    return df.select("listing_id", "governorate_clean", "is_major_city", "is_coastal")


@query("serve_location_flags", f"""
SELECT listing_id, CAST(contains(lower(governorate), 'nation_1') OR contains(lower(coalesce(property_type, '')), 'house') AS INT) AS is_major_city,
       CAST(contains(lower(governorate), 'nation_2') AS INT) AS is_coastal FROM ({LISTINGS_SQL})""")
def _serve_location(spark, sf):
    from hearthline.functions.place import mentions_flag

    return listings(spark, sf).select("listing_id", mentions_flag(["nation_1", "house"], F.col("governorate"), F.col("property_type")).alias("is_major_city"),
                                      mentions_flag(["nation_2"], F.col("governorate")).alias("is_coastal"))


@query("onehot", f"""
WITH top AS (SELECT property_type AS t, row_number() OVER (ORDER BY count(*) DESC, property_type) AS r FROM ({LISTINGS_SQL}) WHERE property_type IS NOT NULL GROUP BY 1)
SELECT listing_id, """ + ", ".join(f"CAST(coalesce(property_type = '{t}', FALSE) AND '{t}' IN (SELECT t FROM top WHERE r <= 10) AS INT) AS is_{t.lower()}"
                                   for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + f" FROM ({LISTINGS_SQL})")
def _onehot(spark, sf):
    df = features.indicator_features(listings(spark, sf).select("listing_id", "property_type"), "property_type", "is_", 10)
    return df.drop("property_type")


@query("market_segment", f"""
SELECT listing_id, CASE WHEN coalesce(price, 0) < 100000 THEN 'Budget' WHEN price < 200000 THEN 'Entry-Level' WHEN price < 400000 THEN 'Mid-Market'
       WHEN price < 800000 THEN 'Upper-Mid' ELSE 'Luxury' END AS batch_segment,
       CASE WHEN coalesce(price, 0) <= 0 THEN 'Mid-Market' WHEN price < 200000 THEN 'Budget' WHEN price < 400000 THEN 'Entry-Level'
       WHEN price < 800000 THEN 'Mid-Market' WHEN price < 1500000 THEN 'Upper-Mid' ELSE 'Luxury' END AS serve_segment FROM ({CLEAN_SQL})""")
def _segment(spark, sf):
    price = F.col("price")
    return clean_listings(spark, sf).select("listing_id", scores.market_segment(price).alias("batch_segment"), scores.market_segment(price, "serve").alias("serve_segment"))


@query("property_score", f"SELECT listing_id, CAST(score AS INT) AS score FROM ({SCORED_SQL})")
def _score(spark, sf):
    return _scored(spark, sf).select("listing_id", "score")


@query("property_tier", f"""
SELECT listing_id, tier, CASE WHEN coalesce(living_area, 0) < 80 THEN 'Basic' WHEN living_area < 120 THEN 'Standard' WHEN living_area < 200 THEN 'Premium' ELSE 'Economy' END AS serve_tier
FROM ({TIERED_SQL})""")
def _tier(spark, sf):
    return _tiered(spark, sf).select("listing_id", "tier", scores.tier_by_area(F.col("living_area")).alias("serve_tier"))


@query("investment_score", f"""
SELECT listing_id, CAST(least(10, 3 * is_major_city + 2 * is_coastal + CASE tier WHEN 'Premium' THEN 3 WHEN 'Standard' THEN 2 WHEN 'Basic' THEN 1 ELSE 0 END
       + CASE WHEN price_per_sqm > 0 AND price_per_sqm < 2000 THEN 2 WHEN price_per_sqm >= 2000 AND price_per_sqm < 3000 THEN 1 ELSE 0 END) AS INT) AS score
FROM ({TIERED_SQL})""")
def _investment(spark, sf):
    return _tiered(spark, sf).select("listing_id", scores.investment_score(
        F.col("is_major_city"), F.col("is_coastal"), F.col("tier"), F.col("price_per_sqm")).alias("score"))


@query("tier_segment_onehot", f"""
SELECT listing_id, {', '.join(f"CAST(tier = '{t}' AS INT) AS tier_{t.lower()}" for t in K.TIERS)} FROM ({TIERED_SQL})""")
def _tier_onehot(spark, sf):
    return _tiered(spark, sf).select("listing_id", *[v.alias(c) for c, v in scores.indicators(F.col("tier"), K.TIERS, "tier_").items()])


@query("log_features", f"""
SELECT listing_id, coalesce(room_count, 0) * coalesce(land_area, 0) AS room_area, round(ln(1 + price), 6) AS log_price, round(ln(1 + land_area), 6) AS log_land_area,
       round(exp(ln(1 + price)) - 1, 2) AS price_back FROM ({CLEAN_SQL})""")
def _log(spark, sf):
    return clean_listings(spark, sf).select(
        "listing_id", scores.room_area(F.col("room_count"), F.col("land_area")).alias("room_area"), F.round(F.log1p("price"), 6).alias("log_price"),
        F.round(F.log1p("land_area"), 6).alias("log_land_area"), F.round(F.expm1(F.log1p("price")), 2).alias("price_back"))


@query("batch_feature_table", f"""
WITH d AS (SELECT l.*, lower(d.text) AS t FROM ({CLEAN_SQL}) l JOIN documents d ON d.doc_id = l.listing_id % (SELECT count(*) FROM documents)),
g AS (SELECT *, {', '.join("CAST(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" AS INT) AS f_{k}" for k, ws in K.AMENITY_KEYWORDS.items())} FROM d)
SELECT listing_id, {' + '.join(f'f_{k}' for k in K.AMENITY_KEYWORDS)} AS luxury_score, f_garden AS has_garden, f_luxury AS has_luxury,
       CAST(contains(t, 'bon état') OR contains(t, 'good condition') OR contains(t, 'bien entretenu') AS INT) AS is_good_condition,
       length(t) AS description_length FROM g""")
def _batch(spark, sf):
    docs = features.text_features(table(spark, sf, "documents"), "text").drop("text", "description_clean", "lang", "source", "n_chars")
    n_docs = table(spark, sf, "documents").agg(F.count("*")).scalar()
    keyed = clean_listings(spark, sf).withColumn("doc_id", F.col("listing_id") % n_docs)
    df = features.batch_features(keyed.join(docs, "doc_id").drop("doc_id"))
    return df.select("listing_id", "luxury_score", "has_garden", "has_luxury", "is_good_condition", F.col("description_length").cast("bigint").alias("description_length"))


@query("serving_feature_table", f"""
WITH d AS (SELECT l.*, lower(d.text) AS t FROM ({CLEAN_SQL}) l JOIN documents d ON d.doc_id = l.listing_id % (SELECT count(*) FROM documents))
SELECT listing_id, coalesce(living_area, 0.0) AS living_area, CAST(coalesce(room_count, 0) AS DOUBLE) AS room_count, CAST(length(t) AS DOUBLE) AS description_length,
       CAST(contains(t, 'jardin') AS DOUBLE) AS has_garden,
       CAST({' + '.join(f"CAST(contains(t, '{w}') AS INT)" for w in K.LUXURY_WORDS)} AS DOUBLE) AS luxury_score,
       CAST(contains(lower(coalesce(property_type, '')), 'house') AS DOUBLE) AS is_house,
       CAST(coalesce(living_area, 0) < 80 AS DOUBLE) AS property_tier_Basic, 61 AS n_features FROM d""")
def _serving(spark, sf):
    raw = described_listings(spark, sf).withColumn("description", F.array("description"))
    df = features.serving_features(raw, keep=["listing_id"])
    return df.select("listing_id", "living_area", "room_count", "description_length", "has_garden", "luxury_score", "is_house", "property_tier_Basic",
                     F.lit(len(df.columns) - 1).alias("n_features"))


@query("standardized", f"""
WITH c AS (SELECT listing_id, living_area FROM ({CLEAN_SQL}))
SELECT listing_id, round((living_area - (SELECT avg(living_area) FROM c)) / (SELECT stddev_pop(living_area) FROM c), 6) AS living_area FROM c""")
def _standard(spark, sf):
    df = stats.standardize(clean_listings(spark, sf).select("listing_id", "living_area"), ["living_area"])
    return df.withColumn("living_area", F.round("living_area", 6))


@query("label_encoded", f"""
SELECT listing_id, CAST(CASE WHEN property_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY property_type NULLS LAST) - 1 END AS INT) AS code FROM ({LISTINGS_SQL})""")
def _encode(spark, sf):
    return stats.label_encode(listings(spark, sf).select("listing_id", "property_type"), "property_type", "code").select("listing_id", "code")
