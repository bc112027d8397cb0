"""Writers. Paths belong on storage every executor reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """NDJSON (or parquet) parts; never one single array file."""
    df.write.mode(mode).format(fmt).save(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add rows as NDJSON, for enriched rows and task-log rows alike."""
    write_records(df, path, "json", "append")


def before_image(df: DataFrame, cols: list[str], key: str, n: int, path: str) -> None:
    """The columns about to be enriched, for the first n rows by key."""
    df.orderBy(key).limit(n).select(*[c for c in cols if c in df.columns]).write.mode("overwrite").json(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a whole new version, then append a pointer to it; readers never see a half table."""
    target = f"{root}/versions/{version}"
    df.write.mode("errorifexists").parquet(target)
    pointer = df.sparkSession.createDataFrame([(target, version)], "path string, version string")
    pointer.coalesce(1).write.mode("append").json(f"{root}/pointers")
    return target


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The version with the greatest name among the pointers."""
    pointers = spark.read.schema("path string, version string").json(f"{root}/pointers")
    return spark.read.parquet(pointers.agg(F.max_by("path", "version")).first()[0])


def snapshot(df: DataFrame, path: str, taken_at: str) -> None:
    """Append the table under its own snapshot partition; a repeated write replaces that partition."""
    (df.withColumn("snapshot_ts", F.lit(taken_at)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").parquet(path))


def write_twins(df: DataFrame, url: str, path: str) -> None:
    """URL list as text and the records as NDJSON."""
    df.select(url).distinct().write.mode("overwrite").text(f"{path}/urls")
    df.write.mode("overwrite").json(f"{path}/records")


def retain_since(df: DataFrame, ts: Column, as_of: Column, days: int = 30) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``."""
    return df.where(ts >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def cleaning_report(raw: DataFrame, clean: DataFrame, funnel: DataFrame, cols: list[str]) -> DataFrame:
    """One row: counts before and after, the funnel steps and null shares per column."""
    from hearthline.operators.profile import compare_profiles

    steps = funnel.agg(F.sort_array(F.collect_list(F.struct("step", "rule", "n_left"))).alias("steps"))
    nulls = compare_profiles(raw, clean, cols).agg(
        F.sort_array(F.collect_list(F.struct("column_name", "before_pct", "after_pct"))).alias("null_shares"))
    return raw.sparkSession.range(1).select(
        raw.agg(F.count("*")).scalar().alias("rows_before"), clean.agg(F.count("*")).scalar().alias("rows_after"),
        steps.scalar().alias("steps"), nulls.scalar().alias("null_shares"))


def feature_report(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: feature list, row count, complete rows and target range."""
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(f"`{c}`").isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(complete).alias("n_complete"),
        F.min(target).alias("target_min"), F.max(target).alias("target_max"), F.avg(target).alias("target_mean"),
    ).withColumn("features", F.array(*[F.lit(c) for c in features])).withColumn("n_features", F.lit(len(features)))


def save_model_table(df: DataFrame, features: list[str], target: str, path: str) -> None:
    """Model-ready table with its metadata beside it."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    feature_report(df, features, target).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
