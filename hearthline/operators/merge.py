"""New-record detection and fill-only merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.text import is_empty
from hearthline.functions.urls import normalize_strict


def first_filled(df: DataFrame, cols: list[str]) -> Column:
    """First non-empty of several URL columns."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols if c in df.columns])


def new_urls(discovered: DataFrame, saved: DataFrame, url: str, saved_url: str | Column, normalize=normalize_strict) -> DataFrame:
    """Discovered URLs not saved yet, one per normalised URL (the smallest spelling).

    Both sides are reduced to distinct keys before the anti-join, so repeated URLs cost nothing.
    """
    saved_col = F.col(saved_url) if isinstance(saved_url, str) else saved_url
    key = normalize(F.col(url))
    usable = key.isNotNull() & ~F.regexp_replace(key, r"^https?:/*", "").isin("", "/")  # null and blank URLs are no news
    fresh = discovered.where(usable).groupBy(key.alias("url_key")).agg(F.min(url).alias(url))
    known = saved.select(normalize(saved_col).alias("url_key")).where(F.col("url_key").isNotNull()).distinct()
    return fresh.join(known, "url_key", "left_anti")


def _missing(c: str, kind: str) -> Column:
    missing = is_empty(F.col(c), "text")
    if kind == "zero_is_gap":
        return missing | (F.col(c).try_cast("double") == 0)
    return missing


def merge_fill(base: DataFrame, patch: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """Fill empty cells of the base from the patch; filled cells never change.

    ``kinds`` gives each column's emptiness rule: 'text', 'number' and 'binary' treat null, blanks
    and null tokens as gaps (0 is a value); 'zero_is_gap' also replaces 0. The patch must have one
    row per key.
    """
    incoming = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in kinds])
    joined = base.join(incoming, key, "left")
    filled = {
        c: F.when(_missing(c, k) & F.col(f"__p_{c}").isNotNull(), F.col(f"__p_{c}")).otherwise(F.col(c))
        for c, k in kinds.items()
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in base.columns])


def merge_preview(base: DataFrame, patch: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(key, column, before, incoming, status) where status is replace, keep or new.

    'new' fills a missing cell, 'replace' changes a zero that counts as a gap, 'keep' leaves a
    filled cell alone.
    """
    incoming = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in kinds])
    joined = base.select(key, *kinds).join(incoming, key)

    def entry(c: str, kind: str) -> Column:
        status = (
            F.when(is_empty(F.col(c)), "new").when(_missing(c, kind), "replace").otherwise("keep")
        )
        return F.when(F.col(f"__p_{c}").isNotNull(), F.struct(
            F.lit(c).alias("column_name"), F.col(c).cast("string").alias("before_value"),
            F.col(f"__p_{c}").cast("string").alias("patch_value"), status.alias("status")))

    entries = F.array_compact(F.array(*[entry(c, k) for c, k in kinds.items()]))
    return joined.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def merge_counts(base: DataFrame, patch: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """Cells updated per column by a merge."""
    incoming = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in kinds])
    joined = base.select(key, *kinds).join(incoming, key)
    wide = joined.agg(*[F.count_if(_missing(c, k) & F.col(f"__p_{c}").isNotNull()).alias(c) for c, k in kinds.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_updated")) for c in kinds])
    return wide.select(F.explode(rows).alias("e")).select("e.*")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of sources with differing columns, tagged with ``data_source``."""
    tagged = [df.withColumn("data_source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
