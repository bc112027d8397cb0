"""Row filters and work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import constants as K
from hearthline.functions.text import is_empty
from hearthline.functions.urls import with_scheme


def drop_missing(df: DataFrame, *cols: str) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_empty_text(df: DataFrame, c: str, keep_null: bool = True) -> DataFrame:
    """Rows whose text is ''; a null is not '' and stays unless told otherwise."""
    return df.where(F.col(c).isNull() | (F.col(c) != "")) if keep_null else df.where(F.col(c) != "")


def exclude_categories(df: DataFrame, c: str, values: list[str] = K.UNWANTED_PROPERTY_TYPES) -> DataFrame:
    """Drop listed categories and nulls."""
    return df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values))


def price_above(df: DataFrame, c: str = "price", floor: float = K.TRAINING_PRICE_FLOOR) -> DataFrame:
    return df.where(F.col(c) > floor)


def within(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Every column inside its closed range."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]))


def needs_enrichment(df: DataFrame, keys: list[str], text: str = "description") -> DataFrame:
    """Rows with a description and at least one missing key field."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    return df.where(F.col(text).isNotNull() & (F.col(text) != "") & missing)


def request_texts(df: DataFrame, key: str, prompt: str, text: str = "description", address: str = "address") -> DataFrame:
    """One request text per row that has a description or an address."""
    usable = df.where(~is_empty(F.col(text)) | ~is_empty(F.col(address)))
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")))
    return usable.select(key, F.concat_ws("\n", F.lit(prompt), part("Description", text), part("Address", address)).alias("request"))


def url_check(df: DataFrame, url: str, provider: str, domains: dict[str, str]) -> DataFrame:
    """Adds a URL with scheme and whether it belongs to the provider; unlisted providers fail,
    providers without a domain accept every URL."""
    full = with_scheme(F.col(url))
    known = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])
    domain = F.element_at(known, F.col(provider))
    ok = (F.trim(F.col(url)) != "") & domain.isNotNull() & ((domain == "") | F.contains(full, domain))
    return df.withColumn("full_url", full).withColumn("url_ok", F.coalesce(ok, F.lit(False)))


def invalid_values(df: DataFrame, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """(key, column, value) for every non-null value outside its domain."""
    bad: list[Column] = [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
        for c, allowed in domains.items()
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*bad))).alias("e")).select(key, "e.*")
