"""Column-level shaping: required, missing, defaulted, aligned and selected columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from hearthline import constants as K


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """The frame itself, or a ValueError naming what is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def column_sets(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns only in a, only in b, and in both, in source order."""
    return {
        "only_first": [c for c in a.columns if c not in b.columns],
        "only_second": [c for c in b.columns if c not in a.columns],
        "common": [c for c in a.columns if c in b.columns],
    }


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: missing ones null, null arrays empty."""

    def one(f: T.StructField) -> Column:
        present = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(present.cast(f.dataType), F.array().cast(f.dataType)).alias(f.name)
        return present.cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


def add_missing_features(df: DataFrame, text: list[str] = K.ENRICH_TEXT_FIELDS,
                         numeric: list[str] = K.ENRICH_NUMERIC_FIELDS,
                         binary: list[str] = K.ENRICH_BINARY_FIELDS) -> DataFrame:
    """Absent features appear with their kind's default: '' for text, null for numbers, 0 for flags."""
    new = {c: F.lit("") for c in text}
    new |= {c: F.lit(None).cast("double") for c in numeric}
    new |= {c: F.lit(0) for c in binary}
    return df.withColumns({c: v for c, v in new.items() if c not in df.columns})


def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the training features in order: missing ones and nulls 0, extra ones dropped."""
    have = set(df.columns)
    return df.select(*(keep or []), *[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
        for c in features
    ])


def features_by_prefix(df: DataFrame, prefixes: tuple[str, ...], extra: list[str] | None = None) -> list[str]:
    """Listed features that exist, then those with a given prefix."""
    first = [c for c in (extra or []) if c in df.columns]
    return first + [c for c in df.columns if c.startswith(prefixes) and c not in first]


def form_record(df: DataFrame) -> DataFrame:
    """Manual form fields as a raw listing: blanks to null (or 'nan'), digit strings to integers."""
    from hearthline.functions.numbers import digit_string_int

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    or_null = lambda c: F.when(~blank(c), F.col(c)).alias(c)
    or_nan = lambda c: F.when(blank(c), F.lit("nan")).otherwise(F.col(c)).alias(c)
    passed = [c for c in ("property_type", "currency", "transaction_type", "has_garage", "has_garden",
                          "has_pool", "has_balcony", "has_terrace", "heating", "air_conditioning",
                          "furnished") if c in df.columns]
    return df.select(
        F.lit("manual_entry").alias("url"), F.lit("manual").alias("source"), *passed,
        or_nan("price"), or_nan("governorate"), or_nan("living_area"),
        F.when(blank("description"), F.array().cast("array<string>")).otherwise(F.array("description")).alias("description"),
        *[or_null(c) for c in ("address", "delegation", "locality", "condition")],
        *[digit_string_int(F.col(c)).alias(c) for c in ("land_area", "room_count", "bathroom_count", "construction_year", "floor")],
    )
