"""Addresses, governorates and location flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hearthline import constants as K
from hearthline.functions.text import clean_text, contains_any, strip, title_case


def split_address(c: Column) -> Column:
    """'site, Delegation - Locality, Governorate' into parts; URL-like parts leave the address."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")
    mid = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    dashed = F.contains(mid, F.lit(" - "))
    pieces = F.split(mid, " - ", 2)
    kept = F.filter(parts, lambda p: ~p.rlike(r"(?i)^https?://|^www\."))
    return F.struct(
        F.nullif(F.array_join(kept, ", "), F.lit("")).alias("address"),
        F.coalesce(F.when(F.size(parts) >= 1, F.element_at(parts, -1)), F.lit("nan")).alias("governorate"),
        F.when(dashed, F.nullif(strip(pieces[0]), F.lit(""))).otherwise(mid).alias("delegation"),
        F.when(dashed, F.nullif(strip(F.get(pieces, F.lit(1))), F.lit(""))).alias("locality"),
    )


def split_in_phrase(c: Column) -> Column:
    """'Locality in Delegation' into parts and a composed address."""
    text = clean_text(c)
    pattern = r"(?iU)^(.*?)\s+in\s+(.*)$"
    locality = clean_text(F.regexp_extract(text, pattern, 1))
    delegation = clean_text(F.regexp_extract(text, pattern, 2))
    return F.struct(
        compose_address(locality, delegation).alias("address"),
        delegation.alias("delegation"),
        locality.alias("locality"),
    )


def compose_address(*parts: Column) -> Column:
    """Non-empty parts joined by ', '; null when none is left."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def standard_governorate(c: Column, rules: dict[str, str] = K.GOVERNORATE_RULES) -> Column:
    """First rule whose key occurs in the name; else title case; null or '' is Unknown."""
    lowered = F.lower(strip(c))
    chain = F.when(c.isNull() | (c == ""), F.lit("Unknown"))
    for key, name in rules.items():
        chain = chain.when(F.contains(lowered, F.lit(key)), F.lit(name))
    return chain.otherwise(title_case(c))


def in_list_flag(c: Column, values: list[str]) -> Column:
    """1 on an exact match, else 0."""
    return F.coalesce(c.isin(*values), F.lit(False)).cast("int")


def mentions_flag(values: list[str], *cols: Column) -> Column:
    """1 when any lower-cased column contains any value."""
    tests = [contains_any(F.lower(F.coalesce(c, F.lit(""))), values) for c in cols]
    return reduce(lambda a, b: a | b, tests).cast("int")
