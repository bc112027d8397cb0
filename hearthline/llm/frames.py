"""Small DataFrame helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.session import keep_shuffles_short, materialize  # noqa: F401

#: Stands for a missing doc_id wherever ids are compared: it counts as larger than every other id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """``id`` (NO_ID if missing) and ``text`` (empty if missing), whatever else the table holds."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(c.alias(n) for n, c in more.items()))


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id; rows with the same id and text share every result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def back_id(col: str = "id") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def merged(df: DataFrame) -> DataFrame:
    """As a side of a join that grows with the rows: sorted and merged, never sent through the driver. Spark would go by the size of a table's
    files, and a table of numbers takes many times that in the driver's memory."""
    return df.hint("merge")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text key are not among ``gone`` (id, key), with their own columns."""
    g = gone.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    mine = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    return docs.join(merged(g), (mine == g["_gone_id"]) & (text_key(docs[text_col]) == g["_gone_key"]), "left_anti")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: later jobs don't compute it again."""
    return materialize(df, f"llm-{label}")
