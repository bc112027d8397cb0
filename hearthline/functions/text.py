"""Text cleaning, hashing and text metrics."""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from hearthline import constants as K

# Worker functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# (?U) makes \s, \w and \b Unicode-aware, as the source patterns assume.
UNICODE = "(?U)"
UNICODE_ICASE = "(?iU)"


def clean_text(c: Column) -> Column:
    """Whitespace runs to one space, trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, UNICODE + r"\s+", " ")), F.lit(""))


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace at both ends."""
    return F.regexp_replace(F.regexp_replace(c, UNICODE + r"^\s++", ""), UNICODE + r"(?<!\s)\s++$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words, no empty entries."""
    return F.filter(F.split(c, UNICODE + r"\s+"), lambda w: w != "")


def is_empty(c: Column, kind: str = "text") -> Column:
    """Null, NaN, blank or a null token. ``kind='number'`` also tests NaN on numeric columns."""
    if kind == "number":
        return c.isNull() | F.isnan(c)
    return c.isNull() | F.lower(strip(c.cast("string"))).isin("", *K.NULL_TOKENS)


def description_hash(c: Column) -> Column:
    """First 16 hex digits of the md5 of the lower-cased, space-collapsed text; '' when empty."""
    return F.substring(description_digest(c), 1, 16)


def description_digest(c: Column) -> Column:
    """The whole md5 behind ``description_hash``: the key to dedupe on, however many texts there are."""
    return F.coalesce(F.md5(clean_text(F.lower(c))), F.lit(""))


def description_lines(html: Column) -> Column:
    """Lines of a description block: <br> breaks lines, other tags vanish, blanks are dropped."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda x: x != "")


def paragraphs(html: Column) -> Column:
    """Cleaned text of every <p> element that has any."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    cleaned = F.transform(raw, lambda p: clean_text(F.regexp_replace(p, r"<[^>]*>", " ")))
    return F.filter(cleaned, lambda x: x.isNotNull())


def to_text_array(c: Column) -> Column:
    """JSON array text or a plain string as one array<string> type."""
    return F.when(
        F.ltrim(c).startswith("["), F.from_json(c, "array<string>")
    ).when(c.isNotNull(), F.array(c))


def flatten_to_text(c: Column, nested: bool = False) -> Column:
    """Array (of arrays) of strings joined by single spaces."""
    return F.array_join(F.flatten(c) if nested else c, " ")


def fix_description(c: Column) -> Column:
    """Lower-case and repair broken French characters; null becomes ''."""
    base = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
                  K.MOJIBAKE_FIXES, base)


def word_count(clean: Column) -> Column:
    """Words of a text as clean_text gives it, where one space separates words."""
    return F.when(clean.isNull(), 0).otherwise(F.size(F.split(clean, " ")))


def avg_word_length(clean: Column) -> Column:
    """Mean characters per word of a cleaned text, 0 for no words."""
    n = F.size(F.split(clean, " "))
    return F.when(clean.isNull(), F.lit(0.0)).otherwise((F.length(clean) - n + 1) / n)


def punctuation_density(c: Column) -> Column:
    """Share of .,!?;: among the characters, 0 for empty text."""
    marks = F.regexp_count(c, F.lit("[.,!?;:]"))
    return F.coalesce(F.try_divide(marks.cast("double"), F.length(c)), F.lit(0.0))


def readability_score(clean: Column) -> Column:
    """Words per sentence plus mean word length of a cleaned text; lower reads easier."""
    sentences = F.greatest(F.regexp_count(clean, F.lit(r"[.!?]+")), F.lit(1))
    return F.coalesce(word_count(clean) / sentences, F.lit(0.0)) + avg_word_length(clean)


def preview(c: Column, length: int = 150) -> Column:
    """First ``length`` characters, with '...' when something was cut."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def title_case(c: Column) -> Column:
    """Every run of letters starts upper-case, so apostrophes and hyphens start a new word."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def contains_any(c: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(k)) for k in keywords])


def found_keywords(c: Column, keywords: list[str]) -> Column:
    """Which of the keywords occur as a substring, null for null text.

    Many keywords in long texts are searched in Python, several times as fast as one expression for each.
    """
    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        wanted = [(k, k.encode()) for k in dict.fromkeys(keywords)]
        rows = texts.cast(pa.binary()).to_pylist()
        return pa.array([None if t is None else [k for k, b in wanted if b in t] for t in rows], pa.list_(pa.string()))

    return find(c)


def keyword_flag(c: Column, keywords: list[str]) -> Column:
    """1 when any keyword occurs as a substring, else 0 (also for null text)."""
    return F.coalesce(contains_any(c, keywords), F.lit(False)).cast("int")


def keyword_flags(c: Column, groups: dict[str, list[str]], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{name}": keyword_flag(c, kws) for name, kws in groups.items()}


def keyword_score(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur at least once."""
    hits = [F.contains(c, F.lit(k)).cast("int") for k in keywords]
    return F.coalesce(reduce(lambda a, b: a + b, hits), F.lit(0))


def stored_or_keyword_flag(stored: Column | None, text: Column, keywords: list[str]) -> Column:
    """1 when the stored boolean is true or the text has a keyword."""
    found = F.coalesce(contains_any(text, keywords), F.lit(False))
    if stored is not None:
        found = found | F.coalesce(stored, F.lit(False))
    return found.cast("int")


def phones(c: Column) -> Column:
    """All phone-like matches, distinct and sorted."""
    found = F.regexp_extract_all(c, F.lit(UNICODE + K.PHONE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def phones_from_fields(*cols: Column) -> Column:
    """Digits and plus signs of each field in order, distinct, empties dropped."""
    cleaned = F.transform(F.array(*cols), lambda x: F.regexp_replace(x, r"[^\d+]", ""))
    return F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))
