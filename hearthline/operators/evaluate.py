"""Model evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline import constants as K
from hearthline.operators.normality import normal_quantile, rank_runs


def _metrics(actual: Column, predicted: Column) -> list[Column]:
    diff = actual - predicted
    ss_res, n = F.sum(diff * diff), F.count(diff)
    mse = F.try_divide(ss_res, n)
    return [
        n.alias("n"),
        (1 - F.try_divide(ss_res, F.var_pop(actual) * n)).alias("r2"),
        F.avg(F.abs(diff)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(F.abs(F.try_divide(diff, actual))) * 100).alias("mape"),
    ]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, r2_of: tuple[str, str] | None = None) -> DataFrame:
    """R2, MAE, MSE, RMSE and MAPE in percent, overall or per group; with ``r2_of`` also the R2 of another pair of columns."""
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    more = [_metrics(F.col(r2_of[0]), F.col(r2_of[1]))[1].alias("r2_of")] if r2_of else []
    return known.groupBy(*(by or [])).agg(*_metrics(F.col(actual), F.col(predicted)), *more)


def price_band(c: Column, bands: str = "small") -> Column:
    chain = None
    for low, high, label in K.PRICE_BANDS[bands]:
        test = c >= low if high is None else (c >= low) & (c < high)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def metrics_by_band(df: DataFrame, actual: str, predicted: str, bands: str = "small") -> DataFrame:
    low, high = K.PRICE_BANDS[bands][0][0], K.PRICE_BANDS[bands][-1][1]
    inside = df.where(F.col(actual) >= low if high is None else (F.col(actual) >= low) & (F.col(actual) < high))
    return regression_metrics(inside.withColumn("price_band", price_band(F.col(actual), bands)), actual, predicted, ["price_band"])


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    r = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"),
                  F.min(r).alias("min_residual"), F.max(r).alias("max_residual"))


def rank_models(results: DataFrame) -> DataFrame:
    """Rank by R2 (desc) and by MAE (asc); one row per model, so one task is enough."""
    w = lambda *o: Window.orderBy(*o)
    return results.withColumns({
        "r2_rank": F.row_number().over(w(F.desc("r2"), "model")),
        "mae_rank": F.row_number().over(w(F.asc("mae"), "model")),
    }).withColumn("is_best", F.col("r2_rank") == 1)


def top_models(results: DataFrame, n: int = 3) -> DataFrame:
    return results.orderBy(F.desc("r2"), "model").limit(n)


def compare_tuning(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Base and tuned metrics side by side per model."""
    names = ("r2", "mae")
    return (
        base.select("model", *[F.col(c).alias(f"base_{c}") for c in names])
        .join(tuned.select("model", *[F.col(c).alias(f"tuned_{c}") for c in names]), "model")
        .withColumn("r2_gain", F.col("tuned_r2") - F.col("base_r2"))
    )


def cumulative_importance(importances: DataFrame) -> DataFrame:
    """Running share of importance, largest first; one row per feature."""
    w = Window.orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return importances.withColumn("cumulative", F.sum("importance").over(w)).withColumn("position", F.count("*").over(w))


def features_needed(importances: DataFrame, levels: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """Number of features to reach each share of importance."""
    cum = cumulative_importance(importances)
    return cum.agg(*[(F.count_if(F.col("cumulative") <= t) + 1).alias(f"features_{round(t * 100)}") for t in levels])


def wide_predictions(df: DataFrame, key: str, models: list[str], n: int = 5) -> DataFrame:
    """First n keys with actual value and one prediction column per model."""
    firsts = df.select(key).distinct().orderBy(key).limit(n)
    return (
        df.join(firsts, key, "left_semi").groupBy(key, "y_true").pivot("model", models).agg(F.first("y_pred")).orderBy(key)
    )


def plotting_position(rank: Column, n: Column) -> Column:
    """Filliben's estimate of the order-statistic medians; ranks start at 1."""
    last = F.pow(F.lit(0.5), 1.0 / n)
    return F.when(rank == n, last).when(rank == 1, 1 - last).otherwise((rank - 0.3175) / (n + 0.365))


def qq_positions(df: DataFrame, c: str) -> DataFrame:
    """(value, rank, position): one row per non-null value. Ranks come from value ranges, not one sort; frequent values are spread over tasks."""
    rank = F.explode(F.sequence("first", "last"))
    return rank_runs(df, c).select("value", rank.alias("rank"), "n_total").withColumn("position", plotting_position(F.col("rank"), F.col("n_total")))


def qq_points(df: DataFrame, c: str) -> DataFrame:
    """Ordered values against normal quantiles."""
    return qq_positions(df, c).withColumn("theoretical", normal_quantile(F.col("position")))


def moments(df: DataFrame, c: str) -> DataFrame:
    """Shape of a distribution: mean, deviation, skewness, excess kurtosis."""
    return df.agg(F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("std_value"),
                  F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
