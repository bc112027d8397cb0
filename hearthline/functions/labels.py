"""Attributes out of titles, option labels, detail lists and page text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hearthline import constants as K
from hearthline.functions.text import UNICODE, UNICODE_ICASE, clean_text


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first (value, pattern) rule that matches, case-insensitive; else null."""
    chain = None
    for value, pattern in rules:
        test = c.rlike(UNICODE_ICASE + pattern)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain


def property_type(text: Column) -> Column:
    return first_match(text, list(K.PROPERTY_TYPE_PATTERNS.items()))


def transaction_type(text: Column, layout: str) -> Column:
    return first_match(text, K.TRANSACTION_PATTERNS[layout])


def contract_transaction(slug: Column) -> Column:
    """'rent' when the contract slug says so, else 'sale'."""
    return F.when(F.contains(slug, F.lit("louer")), F.lit("rent")).otherwise(F.lit("sale"))


def label_flag(labels: Column, variants: list[str]) -> Column:
    """True when a label contains any variant, ignoring case; null when none does."""
    hit = F.exists(labels, lambda x: reduce(Column.__or__, [F.contains(F.lower(x), F.lit(v.lower())) for v in variants]))
    return F.when(hit, F.lit(True))


def label_or_text_flag(labels: Column, variants: list[str] | None, text: Column, pattern: str | None) -> Column:
    """True by label, else by a pattern in the lower-cased text, else null."""
    by_text = F.when(text.rlike(UNICODE + pattern), F.lit(True)) if pattern else F.lit(None).cast("boolean")
    return F.coalesce(label_flag(labels, variants), by_text) if variants else by_text


def stem_flag(text: Column, stem: str) -> Column:
    """True/False: a word starting with the stem occurs."""
    return F.coalesce(F.lower(text).rlike(UNICODE + rf"\b{stem}\w*\b"), F.lit(False))


def agency(page_text: Column, name: str, marker: str) -> Column:
    """The agency name when its marker occurs in the page text."""
    return F.when(page_text.rlike("(?i)" + marker), F.lit(name))


def lookup(details: Column, label: str) -> Column:
    """Value of a label, ignoring case and surrounding space."""
    match = F.filter(
        F.map_entries(details), lambda e: F.lower(clean_text(e["key"])) == label.lower()
    )
    return clean_text(F.get(match, F.lit(0))["value"])


def label_list(details: Column) -> Column:
    """'label: value' texts of a detail map, empty sides dropped."""
    usable = F.filter(
        F.map_entries(details),
        lambda e: clean_text(e["key"]).isNotNull() & clean_text(e["value"]).isNotNull(),
    )
    return F.transform(usable, lambda e: F.concat(clean_text(e["key"]), F.lit(": "), clean_text(e["value"])))


def measure(texts: Column, unit_pattern: str) -> Column:
    """Number in the last text that mentions the unit; spaces and commas group its digits."""
    hits = F.filter(texts, lambda t: t.rlike(UNICODE_ICASE + unit_pattern))
    text = F.element_at(F.when(F.size(hits) > 0, hits), -1)
    run = F.regexp_extract(text, r"\d{1,3}(?:[,\x20\u00A0\u202F]\d{3})+(?!\d)|\d+", 0)
    return F.nullif(F.regexp_replace(run, r"\D", ""), F.lit("")).try_cast("int")


def reference_id(ref_text: Column) -> Column:
    """Digits after 'Rèf:'."""
    return F.nullif(F.regexp_extract(ref_text, UNICODE_ICASE + r"Rèf:\s*([0-9]+)", 1), F.lit(""))


def array_head(c: Column, n: int = 6) -> Column:
    """First n entries and how many follow."""
    return F.struct(
        F.slice(c, 1, n).alias("head"), F.greatest(F.size(c) - n, F.lit(0)).alias("more")
    )
