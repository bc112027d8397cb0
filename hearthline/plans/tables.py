"""Listing tables derived from the generated star schema, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.numbers import clean_price

LISTINGS_SQL = """
SELECT o_orderkey AS listing_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'nan'
            WHEN o_orderkey % 13 = 0 THEN ''
            ELSE CAST(CAST(FLOOR(o_totalprice * 10) AS BIGINT) AS VARCHAR(32)) END AS raw_price,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(20 + o_orderkey % 281 AS DOUBLE) END AS living_area,
       CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_orderkey % 997 AS DOUBLE) END AS land_area,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS room_count,
       CAST(1 + o_orderkey % 3 AS INT) AS bathroom_count,
       n_name AS governorate,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_mktsegment END AS property_type,
       o_orderstatus AS data_source,
       o_orderdate AS listing_ts
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# The cleaned price of LISTINGS_SQL, written independently of the Spark expressions.
CLEAN_SQL = f"""
SELECT listing_id, raw_price,
       CASE WHEN raw_price IN ('nan', '') THEN NULL
            WHEN CAST(raw_price AS DOUBLE) BETWEEN 10000 AND 50000000 THEN CAST(raw_price AS DOUBLE) END AS price,
       living_area, land_area, room_count, bathroom_count, governorate, property_type, data_source, listing_ts
FROM ({LISTINGS_SQL})
"""

PREDICTED_SQL = f"""
SELECT *, price + CAST((listing_id % 41 - 20) * 2500 AS DOUBLE) AS y_pred FROM ({CLEAN_SQL}) WHERE price IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw listing per order: text prices with 'nan' and blanks, gaps, zero areas."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("listing_id"),
        F.when(key % 11 == 0, "nan").when(key % 13 == 0, "")
        .otherwise(F.floor(F.col("o_totalprice") * 10).cast("bigint").cast("string")).alias("raw_price"),
        F.when(key % 7 != 0, (20 + key % 281).cast("double")).alias("living_area"),
        F.when(key % 5 == 0, 0.0).otherwise((key % 997).cast("double")).alias("land_area"),
        F.when(key % 17 != 0, (key % 7).cast("int")).alias("room_count"),
        (1 + key % 3).cast("int").alias("bathroom_count"),
        F.col("n_name").alias("governorate"),
        F.when(key % 19 != 0, F.col("c_mktsegment")).alias("property_type"),
        F.col("o_orderstatus").alias("data_source"),
        F.col("o_orderdate").alias("listing_ts"),
    )


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the cleaned ``price``."""
    return listings(spark, sf_dir).withColumn("price", clean_price(F.col("raw_price")))


def predicted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced listings with a stand-in prediction of known error, so metrics can be checked exactly."""
    known = clean_listings(spark, sf_dir).where(F.col("price").isNotNull())
    return known.withColumn("y_pred", F.col("price") + ((F.col("listing_id") % 41 - 20) * 2500).cast("double"))


def described_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned listings with a document as description. The narrow rows are spread before the join, as the work on texts follows it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    spread = clean_listings(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "listing_id")
    keyed = spread.withColumn("doc_id", F.col("listing_id") % n_docs)
    return keyed.join(docs, "doc_id").drop("doc_id")
