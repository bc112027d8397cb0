"""Raw listing files: JSON arrays, single objects, NDJSON, or an {"items": [...]} wrapper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hearthline.schemas import RAW_SCHEMA

CORRUPT = "_corrupt_record"


def file_layouts(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """(path, multiline) per file, from the first character and whether any line is an object.

    One narrow text pass with a per-file partial aggregate. Callers that know their layout pass it
    to read_listings and skip this pass.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob).text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"),
                F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"))
        .where(F.col("line") != "")
    )
    per_file = lines.groupBy("path").agg(
        F.min_by(F.substring("line", 1, 1), "pos").alias("first"),
        F.max(F.col("line").startswith("{") & F.get_json_object("line", "$").isNotNull()).alias("has_object_line"),
    )
    return per_file.select("path", ((F.col("first") == "[") | ~F.col("has_object_line")).alias("multiline"))


def _read(spark: SparkSession, paths: list[str], multiline: bool, schema: T.StructType) -> DataFrame:
    fields = schema.fields
    full = T.StructType([*fields, T.StructField("items", T.ArrayType(T.StructType(fields))),
                         T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(full).option("multiLine", multiline).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(paths)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )
    own = F.struct(*[F.col(f.name) for f in fields])
    record = F.explode(F.when(F.col("items").isNotNull(), F.col("items")).otherwise(F.array(own))).alias("r")
    return (
        raw.select(record, CORRUPT, "source_file").select("r.*", CORRUPT, "source_file")
        .withColumn("data_source", F.regexp_replace("source_file", r"\.json$", ""))
    )


def read_listings(
    spark: SparkSession,
    path: str | list[str],
    layout: str = "auto",
    exclude: tuple[str, ...] = (".gitkeep", "combined_data.json"),
    schema: T.StructType = RAW_SCHEMA,
) -> DataFrame:
    """All records as text columns with ``data_source``, ``source_file`` and the corrupt text.

    ``layout``: 'lines', 'multiline', or 'auto' to decide per file. Excluded names are not read.
    """
    if layout != "auto":
        df = _read(spark, [path] if isinstance(path, str) else path, layout == "multiline", schema)
        return df.where(~F.col("source_file").isin(*exclude)) if exclude else df
    files = [r for r in file_layouts(spark, path).collect() if r["path"].rsplit("/", 1)[-1] not in exclude]
    groups = {m: [r["path"] for r in files if r["multiline"] == m] for m in (False, True)}
    parts = [_read(spark, paths, m, schema) for m, paths in groups.items() if paths]
    if not parts:
        empty = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType()),
                              T.StructField("source_file", T.StringType()), T.StructField("data_source", T.StringType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantine of unreadable text with its file)."""
    bad = F.col(CORRUPT).isNotNull()
    return df.where(~bad).drop(CORRUPT), df.where(bad).select("source_file", "data_source", CORRUPT)


def read_model_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Model-ready table and its metadata row (feature list and counts), as written by save_model_table."""
    return spark.read.parquet(f"{path}/table"), spark.read.json(f"{path}/metadata")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")
