"""Saved pipelines with a metadata row per training run."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA_SCHEMA = (
    "version string, features array<string>, paths map<string,string>, "
    "results map<string,struct<r2:double,mae:double>>, training_samples long, test_samples long, "
    "target_transform string"
)


def save_models(spark: SparkSession, models: dict[str, PipelineModel], root: str, version: str, features: list[str],
                results: dict[str, tuple[float, float]], training_samples: int, test_samples: int,
                target_transform: str = "log1p") -> None:
    """Write every pipeline, then append one metadata row; the row makes the version visible."""
    paths = {}
    for name, model in models.items():
        paths[name] = f"{root}/models/{name}_{version}"
        model.write().overwrite().save(paths[name])
    row = (version, features, paths, results, training_samples, test_samples, target_transform)
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/metadata")


def model_metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{root}/metadata")


def load_latest(spark: SparkSession, root: str) -> tuple[dict[str, PipelineModel], dict]:
    """Pipelines and metadata of the newest version."""
    meta = model_metadata(spark, root).orderBy(F.desc("version")).limit(1).first().asDict(recursive=True)
    return {name: PipelineModel.load(path) for name, path in meta["paths"].items()}, meta


def metrics_table(metadata: DataFrame) -> DataFrame:
    """(version, model, r2, mae, samples) out of the metadata rows."""
    return metadata.select("version", "training_samples", "test_samples", F.explode("results").alias("model", "m")).select(
        "version", "model", F.col("m.r2").alias("r2"), F.col("m.mae").alias("mae"), "training_samples", "test_samples")
