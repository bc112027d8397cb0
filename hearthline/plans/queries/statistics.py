"""Imputation, capping, correlation and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import ranking, stats
from hearthline.plans.catalog import query
from hearthline.plans.tables import CLEAN_SQL, clean_listings, table

NUMERIC = ["living_area", "land_area", "room_count", "bathroom_count"]


@query("quantiles", f"""
WITH c AS (SELECT price FROM ({CLEAN_SQL}))
SELECT 'price' AS column_name, p AS prob, round(v, 4) AS value FROM (
SELECT unnest([0.01, 0.25, 0.5, 0.99])::DOUBLE AS p, unnest(quantile_cont(price, [0.01, 0.25, 0.5, 0.99])) AS v FROM c)""")
def _quantiles(spark, sf):
    return ranking.quantiles(clean_listings(spark, sf), ["price"], [0.01, 0.25, 0.5, 0.99]).withColumn("value", F.round("value", 4))


@query("quantiles_by_range", """
SELECT l_returnflag, 'l_extendedprice' AS column_name, p AS prob, round(v, 4) AS value FROM (
SELECT l_returnflag, unnest([0.1, 0.5, 0.9])::DOUBLE AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS v FROM lineitem GROUP BY 1)""")
def _quantiles_ranges(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    q = ranking.quantiles(lines, ["l_extendedprice"], [0.1, 0.5, 0.9], ["l_returnflag"])
    return q.withColumn("value", F.round("value", 4))


@query("median_impute", f"""
WITH c AS (SELECT * FROM ({CLEAN_SQL}))
SELECT listing_id, coalesce(living_area, (SELECT median(living_area) FROM c)) AS living_area,
       coalesce(CAST(room_count AS DOUBLE), (SELECT CAST(median(room_count) AS DOUBLE) FROM c)) AS room_count FROM c""")
def _median(spark, sf):
    return stats.impute_median(clean_listings(spark, sf).select("listing_id", "living_area", "room_count"), ["living_area", "room_count"])


@query("mode_impute", f"""
WITH c AS (SELECT listing_id, property_type FROM ({CLEAN_SQL}))
SELECT listing_id, coalesce(property_type, (SELECT property_type FROM c WHERE property_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS property_type,
       'unknown' AS condition FROM c""")
def _mode(spark, sf):
    df = clean_listings(spark, sf).select("listing_id", "property_type", F.lit(None).cast("string").alias("condition"))
    return stats.impute_mode(df, ["property_type", "condition"])


@query("cap_outliers", f"""
WITH c AS (SELECT listing_id, price, land_area FROM ({CLEAN_SQL})),
q AS (SELECT quantile_cont(price, 0.01) AS pl, quantile_cont(price, 0.99) AS ph, quantile_cont(land_area, 0.01) AS ll, quantile_cont(land_area, 0.99) AS lh FROM c)
SELECT listing_id, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, pl), ph) END, 4) AS price,
       round(CASE WHEN land_area IS NOT NULL THEN least(greatest(land_area, ll), lh) END, 4) AS land_area FROM c, q""")
def _cap(spark, sf):
    df = stats.cap(clean_listings(spark, sf).select("listing_id", "price", "land_area"), ["price", "land_area"])
    return df.withColumns({c: F.round(c, 4) for c in ("price", "land_area")})


@query("corr_with_target", f"WITH c AS ({CLEAN_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, price), 6) AS corr, round(abs(corr({c}, price)), 6) AS abs_corr FROM c" for c in NUMERIC))
def _corr(spark, sf):
    return stats.correlations(clean_listings(spark, sf), NUMERIC, "price").withColumns({c: F.round(c, 6) for c in ("corr", "abs_corr")})


@query("top_correlations", f"WITH c AS ({CLEAN_SQL}), r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, price)), 6) AS abs_corr FROM c" for c in NUMERIC) + ") SELECT * FROM r ORDER BY abs_corr DESC LIMIT 2")
def _top_corr(spark, sf):
    return stats.top_correlations(clean_listings(spark, sf), NUMERIC, "price", 2).select("feature", F.round("abs_corr", 6).alias("abs_corr"))


@query("corr_matrix", f"WITH c AS ({CLEAN_SQL}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM c" for a in NUMERIC for b in NUMERIC))
def _matrix(spark, sf):
    return stats.correlation_matrix(clean_listings(spark, sf), NUMERIC).withColumn("corr", F.round("corr", 6))


@query("f_scores", f"""WITH c AS (SELECT * FROM ({CLEAN_SQL}) WHERE price IS NOT NULL AND living_area IS NOT NULL AND land_area IS NOT NULL AND room_count IS NOT NULL) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, price) ^ 2 / (1 - corr({c}, price) ^ 2) * (count(*) - 2), 5) AS f_score FROM c" for c in NUMERIC))
def _f(spark, sf):
    return stats.f_scores(clean_listings(spark, sf), NUMERIC, "price").withColumn("f_score", F.round("f_score", 5))


@query("price_pivot", f"""
SELECT bathroom_count, avg(price) FILTER (listing_id % 2 = 0) AS even, avg(price) FILTER (listing_id % 2 = 1) AS odd FROM ({CLEAN_SQL}) GROUP BY 1""")
def _pivot(spark, sf):
    df = clean_listings(spark, sf).withColumn("parity", F.when(F.col("listing_id") % 2 == 0, "even").otherwise("odd"))
    return stats.mean_pivot(df, "price", "bathroom_count", "parity", ["even", "odd"])


@query("outlier_flags", f"""
WITH c AS (SELECT listing_id, price FROM ({CLEAN_SQL})),
q AS (SELECT quantile_cont(price, 0.01) AS p1, quantile_cont(price, 0.99) AS p99, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_samp(price) AS s FROM c)
SELECT listing_id, price < p1 OR price > p99 AS outside_percentiles, price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) AS iqr_outlier, abs(price - m) > 1.5 * s AS zscore_outlier FROM c, q""")
def _outliers(spark, sf):
    df = clean_listings(spark, sf).select("listing_id", "price")
    return stats.outlier_flags(df, "price", z=1.5).drop("price")


@query("drop_correlated_features", f"""
SELECT listing_id, living_area, room_count, land_area FROM ({CLEAN_SQL})""")
def _drop_correlated(spark, sf):
    df = clean_listings(spark, sf).select("listing_id", "living_area", "room_count", "land_area").withColumns(
        {"area_copy": F.col("living_area") * 2 + 1, "constant": F.lit(3.0)})
    features = ["living_area", "area_copy", "room_count", "land_area"]
    return df.drop(*stats.correlated_features(df, features), *stats.low_variance_features(df, [*features, "constant"]))
