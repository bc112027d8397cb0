"""Batch scoring: serving features, model, prediction record."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, functions as F

from hearthline import constants as K
from hearthline.functions import numbers, scores
from hearthline.operators.features import serving_features
from hearthline.plans.training import NODE_IDS, balanced


def serving_rows(listings: DataFrame, key: str, target: str | None = "price") -> DataFrame:
    """(key, __target, __currency, serving features): what both fitting and scoring read of a listing, narrow and without its texts."""
    currency = F.col("currency") if "currency" in listings.columns else F.lit(None).cast("string")
    wanted = F.col(target).cast("double") if target else F.lit(None).cast("double")
    return serving_features(listings.withColumns({"__currency": currency, "__target": wanted}), keep=[key, "__target", "__currency"])


def fit_serving_rows(rows: DataFrame, key: str, seed: int = 42, include_leaky: bool = False, **forest) -> PipelineModel:
    """Random forest on ``serving_rows``. Price-derived inputs are left out unless asked for."""
    leaky = ("price_per_sqm", "market_segment_")
    names = [c for c in K.SERVING_FEATURES if include_leaky or not c.startswith(leaky)]
    known = balanced(rows.where(F.col("__target").isNotNull()), key).drop(key, "__currency").persist()
    forest = {"numTrees": 50, "maxDepth": 10, **NODE_IDS, **forest}
    model = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
        RandomForestRegressor(labelCol="__target", featuresCol="features", seed=seed, **forest),
    ]).fit(known)
    known.unpersist()
    return model


def fit_serving_model(listings: DataFrame, key: str, target: str = "price", seed: int = 42, include_leaky: bool = False, **forest) -> PipelineModel:
    """Random forest on the serving features. Price-derived inputs are left out unless asked for."""
    return fit_serving_rows(serving_rows(listings, key, target), key, seed, include_leaky, **forest)


def predict(listings: DataFrame, model: PipelineModel | None, key: str) -> DataFrame:
    """(key, result): one prediction record per listing, or the fallback without a model."""
    if model is None:
        currency = F.col("currency") if "currency" in listings.columns else F.lit(None).cast("string")
        price = numbers.safe_float(F.col("price")) if "price" in listings.columns else F.lit(0.0)
        return listings.select(key, scores.fallback_prediction(price, currency).alias("result"))
    return predict_rows(serving_rows(listings, key, None), model, key)


def predict_rows(rows: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """(key, result): one prediction record for each of ``serving_rows``."""
    features = [F.col(f"`{c}`") for c in K.SERVING_FEATURES]
    factors = scores.prediction_factors(*[F.col(c) for c in ("living_area", "room_count", "has_luxury", "is_major_city", "has_pool", "is_coastal")])
    scored = model.transform(rows)
    result = scores.prediction_result(F.col("prediction"), scores.completeness_confidence(features), F.col("__currency"), factors)
    return scored.select(key, result.alias("result"))
