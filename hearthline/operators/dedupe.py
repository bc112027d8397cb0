"""Keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.text import description_digest


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str], unique_when: Column | None = None) -> DataFrame:
    """First row per key by the order columns, which must be unique within a key.

    An aggregate instead of a window: every input partition passes on at most one row per key, so
    a key held by a third of the rows never lands in one task. Null keys are equal to each other.
    Rows where ``unique_when`` holds are never duplicates: their order columns join their key, which
    keeps one scan and spreads them evenly.
    """
    names = [F.col(k) if isinstance(k, str) else k for k in keys]
    if unique_when is not None:
        names.append(F.when(unique_when, F.struct(*order)))
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(names)]).agg(first).select("__row.*")


def dedupe_descriptions(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """By description hash; rows without a description are all kept."""
    hashed = df.withColumn("__hash", description_digest(F.col(text)))
    return keep_first(hashed, ["__hash"], order, F.col("__hash") == "").drop("__hash")


def combine_stats(df: DataFrame, source: str, key: str, order: str, unique_when: Column) -> DataFrame:
    """Per source: rows loaded, rows keep_first would keep, duplicates skipped.

    Rows are reduced to one per (key, source) before the first source of a key is looked up.
    """
    groups = df.groupBy(source, key, unique_when.alias("__unique")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    wins = F.col("first") == F.min("first").over(Window.partitionBy(key))
    kept = F.when(F.col("__unique"), F.col("n")).when(wins, 1).otherwise(0)
    return (
        groups.withColumn("kept", kept).groupBy(source)
        .agg(F.sum("n").alias("n_loaded"), F.sum("kept").alias("n_kept"))
        .withColumn("n_duplicates", F.col("n_loaded") - F.col("n_kept"))
    )
