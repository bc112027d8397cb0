"""Evaluation, ranking and prediction-display queries on a stand-in prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import scores
from hearthline.operators import evaluate, normality, stats
from hearthline.plans.catalog import query
from hearthline.plans.tables import CLEAN_SQL, PREDICTED_SQL, clean_listings, predicted_listings

METRICS = """count(*) AS n, round(1 - sum((price - y_pred) ^ 2) / (var_pop(price) * count(*)), 6) AS r2, round(avg(abs(price - y_pred)), 4) AS mae,
       round(avg((price - y_pred) ^ 2), 3) AS mse, round(sqrt(avg((price - y_pred) ^ 2)), 4) AS rmse, round(avg(abs((price - y_pred) / price)) * 100, 6) AS mape"""
PLACES = {"r2": 6, "mae": 4, "mse": 3, "rmse": 4, "mape": 6}


def _round(df):
    return df.withColumns({c: F.round(c, p) for c, p in PLACES.items()})


@query("regression_metrics", f"SELECT {METRICS} FROM ({PREDICTED_SQL})")
def _metrics(spark, sf):
    return _round(evaluate.regression_metrics(predicted_listings(spark, sf), "price", "y_pred"))


@query("metrics_by_type", f"SELECT property_type, {METRICS} FROM ({PREDICTED_SQL}) GROUP BY 1")
def _by_type(spark, sf):
    return _round(evaluate.regression_metrics(predicted_listings(spark, sf), "price", "y_pred", ["property_type"]))


def _band_sql(bands):
    case = " ".join(f"WHEN price >= {lo} {'' if hi is None else f'AND price < {hi}'} THEN '{label}'" for lo, hi, label in bands)
    return f"SELECT CASE {case} END AS price_band, {METRICS} FROM ({PREDICTED_SQL}) GROUP BY 1"


@query("metrics_by_band", _band_sql([(0, 50_000, "Low ($0-50K)"), (50_000, 100_000, "Medium ($50K-100K)"), (100_000, 200_000, "High ($100K-200K)"), (200_000, None, "Very High ($200K+)")]))
def _by_band(spark, sf):
    return _round(evaluate.metrics_by_band(predicted_listings(spark, sf), "price", "y_pred"))


@query("metrics_by_wide_band", _band_sql([(0, 200_000, "0-200K"), (200_000, 500_000, "200K-500K"), (500_000, 1_000_000, "500K-1M"), (1_000_000, None, "1M+")]))
def _by_wide_band(spark, sf):
    return _round(evaluate.metrics_by_band(predicted_listings(spark, sf), "price", "y_pred", "documented"))


@query("residual_summary", f"""
SELECT round(avg(price - y_pred), 4) AS mean_residual, round(stddev_samp(price - y_pred), 4) AS std_residual,
       min(price - y_pred) AS min_residual, max(price - y_pred) AS max_residual FROM ({PREDICTED_SQL})""")
def _residuals(spark, sf):
    df = evaluate.residual_summary(predicted_listings(spark, sf), "price", "y_pred")
    return df.withColumns({c: F.round(c, 4) for c in ("mean_residual", "std_residual")})


@query("row_errors", f"SELECT listing_id, price - y_pred AS residual, round(abs((price - y_pred) / price), 6) AS ape FROM ({PREDICTED_SQL})")
def _row_errors(spark, sf):
    y, p = F.col("price"), F.col("y_pred")
    return predicted_listings(spark, sf).select("listing_id", scores.residual(y, p).alias("residual"), F.round(scores.abs_pct_error(y, p), 6).alias("ape"))


def _three_models(spark, sf):
    """Stand-in predictions of three models with different error sizes, long form."""
    base = predicted_listings(spark, sf)
    error = F.col("y_pred") - F.col("price")
    models = F.array(*[F.struct(F.lit(m).alias("model"), (F.col("price") + error * k).alias("y_pred")) for m, k in (("wide", 2), ("mid", 1), ("sharp", 0.5))])
    return base.select("listing_id", F.col("price").alias("y_true"), F.explode(models).alias("m")).select("listing_id", "y_true", "m.*")


MODELS_SQL = f"""SELECT listing_id, price AS y_true, m AS model, price + (y_pred - price) * k AS y_pred
FROM ({PREDICTED_SQL}), (VALUES ('wide', 2.0::DOUBLE), ('mid', 1.0::DOUBLE), ('sharp', 0.5::DOUBLE)) v(m, k)"""


@query("model_ranking", f"""
WITH r AS (SELECT model, 1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2, avg(abs(y_true - y_pred)) AS mae FROM ({MODELS_SQL}) GROUP BY 1)
SELECT model, round(r2, 6) AS r2, round(mae, 4) AS mae, row_number() OVER (ORDER BY r2 DESC) AS r2_rank, row_number() OVER (ORDER BY mae) AS mae_rank,
       row_number() OVER (ORDER BY r2 DESC) = 1 AS is_best FROM r""")
def _ranking(spark, sf):
    results = evaluate.regression_metrics(_three_models(spark, sf), "y_true", "y_pred", ["model"]).select("model", "r2", "mae")
    ranked = evaluate.rank_models(results).withColumns({"r2": F.round("r2", 6), "mae": F.round("mae", 4)})
    return ranked.withColumns({c: F.col(c).cast("bigint") for c in ("r2_rank", "mae_rank")})


@query("top_models", f"""
SELECT model, round(1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)), 6) AS r2 FROM ({MODELS_SQL}) GROUP BY 1 ORDER BY r2 DESC LIMIT 2""")
def _top_models(spark, sf):
    results = evaluate.regression_metrics(_three_models(spark, sf), "y_true", "y_pred", ["model"])
    return evaluate.top_models(results, 2).select("model", F.round("r2", 6).alias("r2"))


@query("tuning_gain", f"""
WITH r AS (SELECT model, 1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2, avg(abs(y_true - y_pred)) AS mae,
           1 - sum(((y_true - y_pred) / 2) ^ 2) / (var_pop(y_true) * count(*)) AS t2, avg(abs(y_true - y_pred) / 2) AS tm FROM ({MODELS_SQL}) GROUP BY 1)
SELECT model, round(r2, 6) AS base_r2, round(mae, 4) AS base_mae, round(t2, 6) AS tuned_r2, round(tm, 4) AS tuned_mae, round(t2 - r2, 6) AS r2_gain FROM r""")
def _tuning(spark, sf):
    rows = _three_models(spark, sf)
    base = evaluate.regression_metrics(rows, "y_true", "y_pred", ["model"])
    halved = rows.withColumn("y_pred", F.col("y_true") - (F.col("y_true") - F.col("y_pred")) / 2)
    gain = evaluate.compare_tuning(base, evaluate.regression_metrics(halved, "y_true", "y_pred", ["model"]))
    return gain.withColumns({c: F.round(c, 4 if c.endswith("mae") else 6) for c in gain.columns if c != "model"})


@query("sample_predictions_wide", f"""
SELECT listing_id, y_true, any_value(y_pred) FILTER (model = 'wide') AS wide, any_value(y_pred) FILTER (model = 'mid') AS mid, any_value(y_pred) FILTER (model = 'sharp') AS sharp
FROM ({MODELS_SQL}) GROUP BY 1, 2 ORDER BY 1 LIMIT 10""")
def _wide(spark, sf):
    return evaluate.wide_predictions(_three_models(spark, sf), "listing_id", ["wide", "mid", "sharp"], 10)


IMPORTANCE_SQL = f"WITH c AS ({CLEAN_SQL}), r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, listing_id)), 4) AS importance FROM c" for c in ("price", "living_area", "land_area", "room_count", "bathroom_count")) + ")"


def _importances(spark, sf):
    cols = ["price", "living_area", "land_area", "room_count", "bathroom_count"]
    return stats.correlations(clean_listings(spark, sf), cols, "listing_id").select("feature", F.round("abs_corr", 4).alias("importance"))


@query("cumulative_importance", f"""{IMPORTANCE_SQL}
SELECT feature, importance, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 4) AS cumulative,
       row_number() OVER (ORDER BY importance DESC, feature) AS position FROM r""")
def _cumulative(spark, sf):
    return evaluate.cumulative_importance(_importances(spark, sf)).withColumn("cumulative", F.round("cumulative", 4))


@query("features_needed", f"""{IMPORTANCE_SQL}, s AS (SELECT sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS c FROM r)
SELECT count(*) FILTER (c <= 0.01) + 1 AS features_1, count(*) FILTER (c <= 0.9) + 1 AS features_90 FROM s""")
def _needed(spark, sf):
    return evaluate.features_needed(_importances(spark, sf), (0.01, 0.9))


@query("price_gap", f"""
WITH g AS (SELECT listing_id, y_pred - price AS d, round((y_pred - price) * 100.0 / price, 1) AS gap_pct FROM ({PREDICTED_SQL}))
SELECT listing_id, gap_pct, CASE WHEN d > 0 THEN '+' || format('{{:.1f}}', abs(gap_pct)) || '% above market'
       WHEN d < 0 THEN format('{{:.1f}}', abs(gap_pct)) || '% below market' ELSE 'At market value' END AS gap_text FROM g""")
def _gap(spark, sf):
    return predicted_listings(spark, sf).select("listing_id", scores.price_gap(F.col("y_pred"), F.col("price")).alias("g")).select("listing_id", "g.*")


@query("fallback_prediction", f"""
WITH f AS (SELECT listing_id, price, CASE WHEN price > 0 THEN CAST(floor(price * 0.95::DOUBLE) AS BIGINT) ELSE 450000 END AS p FROM ({CLEAN_SQL}))
SELECT listing_id, p AS predicted_price, CASE WHEN price > 0 THEN CAST(floor(p * 0.9::DOUBLE) AS BIGINT) ELSE 400000 END AS min,
       CASE WHEN price > 0 THEN CAST(floor(p * 1.1::DOUBLE) AS BIGINT) ELSE 500000 END AS max, 'TND' AS currency FROM f""")
def _fallback(spark, sf):
    from hearthline.plans.scoring import predict

    df = predict(clean_listings(spark, sf), None, "listing_id")
    return df.select("listing_id", "result.predicted_price", "result.price_range.min", "result.price_range.max", "result.currency")


@query("prediction_records", f"""
WITH f AS (SELECT listing_id, living_area, room_count, greatest(50000, y_pred) AS p, (CAST(coalesce(living_area, 0) <> 0 AS INT) + CAST(coalesce(room_count, 0) <> 0 AS INT) + CAST(coalesce(land_area, 0) <> 0 AS INT)) / 3.0 AS c FROM ({PREDICTED_SQL}))
SELECT listing_id, CAST(floor(p) AS BIGINT) AS predicted_price, round(least(0.95, greatest(0.6, c)), 4) AS confidence, CAST(floor(p - p * 0.15::DOUBLE) AS BIGINT) AS min,
       CAST(floor(p + p * 0.15::DOUBLE) AS BIGINT) AS max, CASE WHEN c > 0.7 THEN 'market_average' ELSE 'uncertain' END AS status,
       (CAST(coalesce(room_count, 0) > 0 AS INT) + CAST(coalesce(living_area, 0) > 0 AS INT) + CAST(listing_id % 2 = 1 AS INT)) AS n_factors FROM f""")
def _records(spark, sf):
    df = predicted_listings(spark, sf)
    odd = (F.col("listing_id") % 2).cast("int")
    factors = scores.prediction_factors(F.col("living_area"), F.col("room_count"), odd, F.lit(0), F.lit(0), F.lit(0))
    confidence = scores.completeness_confidence([F.col(c) for c in ("living_area", "room_count", "land_area")])
    result = scores.prediction_result(F.col("y_pred"), confidence, F.lit(None).cast("string"), factors)
    n = F.when(F.array_contains("r.factors", "Basic property features"), 0).otherwise(F.size("r.factors"))
    return df.select("listing_id", result.alias("r")).select(
        "listing_id", "r.predicted_price", F.round("r.confidence", 4).alias("confidence"), "r.price_range.min", "r.price_range.max",
        F.col("r.market_analysis.status").alias("status"), n.alias("n_factors"))


@query("model_grades", f"""
WITH r AS (SELECT model, 1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2, avg(abs((y_true - y_pred) / y_true)) * 100 AS mape FROM ({MODELS_SQL}) GROUP BY 1)
SELECT model, CASE WHEN mape < 10 THEN 'Excellent' WHEN mape < 20 THEN 'Good' WHEN mape < 30 THEN 'Moderate' ELSE 'Poor' END AS mape_grade,
       CASE WHEN r2 > 0.8 THEN 'Strong' WHEN r2 > 0.6 THEN 'Good' WHEN r2 > 0.4 THEN 'Moderate' ELSE 'Weak' END AS r2_grade, r2 - 0.85 > 0.1 AS overfit FROM r""")
def _grades(spark, sf):
    results = evaluate.regression_metrics(_three_models(spark, sf), "y_true", "y_pred", ["model"])
    return results.select("model", scores.mape_grade(F.col("mape")).alias("mape_grade"), scores.r2_grade(F.col("r2")).alias("r2_grade"),
                          scores.overfit_flag(F.col("r2"), F.lit(0.85)).alias("overfit"))


@query("qq_positions", f"""
WITH r AS (SELECT price - y_pred AS value, row_number() OVER (ORDER BY price - y_pred) AS rank, count(*) OVER () AS n FROM ({PREDICTED_SQL}))
SELECT value, rank, n AS n_total, round(CASE WHEN rank = n THEN 0.5 ^ (1.0 / n) WHEN rank = 1 THEN 1 - 0.5 ^ (1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END, 8) AS position FROM r""")
def _qq(spark, sf):
    df = predicted_listings(spark, sf).withColumn("residual", F.col("price") - F.col("y_pred"))
    return evaluate.qq_positions(df, "residual").withColumn("position", F.round("position", 8))


def _poly_sql(coefficients, x):
    """sum of c * x^i, innermost first."""
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return f"{out}::DOUBLE"


def _ratio_sql(fit, x):
    return f"{_poly_sql(fit[0], x)} / {_poly_sql(fit[1], x)}"


def _quantile_sql(p):
    """The normal quantile by the published approximations."""
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = (_ratio_sql(fit, f"({tail} - {x})") for fit, x in ((normality.QUANTILE_NEAR, 1.6), (normality.QUANTILE_FAR, 5.0)))
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_ratio_sql(normality.QUANTILE_MIDDLE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
            f"ELSE sign({p} - 0.5) * CASE WHEN {tail} <= 5 THEN {near} ELSE {far} END END")


@query("qq_points", f"""
WITH r AS (SELECT price - y_pred AS value, row_number() OVER (ORDER BY price - y_pred) AS rank, count(*) OVER () AS n FROM ({PREDICTED_SQL})),
p AS (SELECT value, rank, n, CASE WHEN rank = n THEN 0.5 ^ (1.0 / n) WHEN rank = 1 THEN 1 - 0.5 ^ (1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM r)
SELECT value, rank, n AS n_total, round(p, 8) AS position, round({_quantile_sql("p")}, 8) AS theoretical FROM p""")
def _qq_points(spark, sf):
    df = predicted_listings(spark, sf).withColumn("residual", F.col("price") - F.col("y_pred"))
    return evaluate.qq_points(df, "residual").withColumns({c: F.round(c, 8) for c in ("position", "theoretical")})


# --- fixed values: tail of the normal distribution (Abramowitz and Stegun 26.2.17), to 1e-7 ---------------
TAIL_SCALE = 0.2316419
TAIL = (0.0, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _shapiro_sql(values):
    """Both statistics from every value and its own weight, for more than 11 of them."""
    tail = lambda z: f"(CASE WHEN {z} >= 0 THEN 1 ELSE -1 END * (exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {_poly_sql(TAIL, f'(1 / (1 + {TAIL_SCALE} * abs({z})))')}) + CASE WHEN {z} >= 0 THEN 0 ELSE 1 END)"
    return f"""
WITH v AS ({values}), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, avg(x) OVER () AS mean FROM v),
p AS (SELECT x - mean AS x, i, n, ((i - 0.375) / (n + 0.25))::DOUBLE AS p FROM r),
m AS (SELECT x, i, n, {_quantile_sql("p")} AS m FROM p),
s AS (SELECT n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(n) AS u FROM m GROUP BY n),
a AS (SELECT *, m1 / sqrt(mm) + {_poly_sql(normality.LAST_WEIGHT, "u")} AS a1, m2 / sqrt(mm) + {_poly_sql(normality.SECOND_LAST_WEIGHT, "u")} AS a2 FROM s),
f AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM a),
w AS (SELECT any_value(m.n) AS n, sum(x * CASE WHEN i = m.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = m.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt(phi) END) ^ 2 / sum(x * x) AS w,
      sum(x * m) ^ 2 / (any_value(mm) * sum(x * x)) AS f, ln(any_value(m.n)) AS l FROM m, f),
z AS (SELECT n, w, f, (ln(1 - w) - {_poly_sql(normality.WILK_MEAN, "l")}) / exp({_poly_sql(normality.WILK_LOG_DEVIATION, "l")}) AS zw,
      (ln(1 - f) - (-1.2725 + 1.0521 * (ln(l) - l))) / (1.0308 - 0.26758 * (ln(l) + 2 / l)) AS zf FROM w)
SELECT n, round(w, 9) AS shapiro_wilk_w, round({tail("zw")}, 5) AS shapiro_wilk_p, round(f, 9) AS shapiro_francia_w, round({tail("zf")}, 5) AS shapiro_francia_p FROM z"""


def _rounded_shapiro(df, c):
    found = normality.shapiro(df, c)
    return found.withColumns({x: F.round(x, 5 if x.endswith("p") else 9) for x in found.columns if x != "n"})


@query("residual_shapiro", _shapiro_sql(f"SELECT price - y_pred AS x FROM ({PREDICTED_SQL})"))
def _shapiro(spark, sf):
    return _rounded_shapiro(predicted_listings(spark, sf).withColumn("residual", F.col("price") - F.col("y_pred")), "residual")


@query("room_count_shapiro", _shapiro_sql(f"SELECT room_count::DOUBLE AS x FROM ({CLEAN_SQL}) WHERE room_count IS NOT NULL"))
def _shapiro_ties(spark, sf):
    """A column of few values: every rank belongs to a long run."""
    return _rounded_shapiro(clean_listings(spark, sf), "room_count")


@query("residual_shape", f"""
WITH r AS (SELECT price - y_pred AS x FROM ({PREDICTED_SQL})), m AS (SELECT x - avg(x) OVER () AS d, x FROM r)
SELECT round(avg(x), 4) AS mean_value, round(stddev_samp(x), 4) AS std_value, round(avg(d ^ 3) / avg(d ^ 2) ^ 1.5, 6) AS skewness, round(avg(d ^ 4) / avg(d ^ 2) ^ 2 - 3, 6) AS kurtosis FROM m""")
def _shape(spark, sf):
    df = predicted_listings(spark, sf).withColumn("residual", F.col("price") - F.col("y_pred"))
    return evaluate.moments(df, "residual").withColumns({c: F.round(c, 4 if c.endswith("value") else 6) for c in ("mean_value", "std_value", "skewness", "kurtosis")})
