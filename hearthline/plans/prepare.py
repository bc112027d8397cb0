"""Raw listings to a clean, deduplicated, summarised table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline.functions.scores import batch_ratios, market_segment
from hearthline.functions.text import to_text_array
from hearthline.operators.dedupe import dedupe_descriptions
from hearthline.operators.filters import exclude_categories


def combine(raw: DataFrame) -> DataFrame:
    """Raw listing files as read by read_listings: one text description, first copy kept.

    Records without a description are never copies of each other.
    """
    flat = raw.withColumn("description", F.array_join(to_text_array(F.col("description")), " "))
    return dedupe_descriptions(flat, "description", ["source_file", "url", "id"])


def segment_summary(clean: DataFrame) -> DataFrame:
    """Priced, typed listings per governorate and segment: counts and price per square metre."""
    kept = exclude_categories(clean.where(F.col("price").isNotNull()), "property_type")
    ratio = batch_ratios(*[F.col(c) for c in ("price", "living_area", "land_area", "room_count", "bathroom_count")])
    return (
        kept.withColumn("price_per_sqm", ratio["price_per_sqm"]).withColumn("market_segment", market_segment(F.col("price")))
        .groupBy("governorate", "market_segment")
        .agg(F.count("*").alias("n_listings"), F.avg("price").alias("avg_price"),
             F.round(F.avg("price_per_sqm"), 4).alias("avg_price_per_sqm"))
    )
