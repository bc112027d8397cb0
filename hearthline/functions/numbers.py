"""Numbers out of text. ANSI mode is on, so every cast is a try_cast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline import constants as K
from hearthline.functions.text import UNICODE


# Letters that Java's number parser would accept (5d, 0x1p3, NaN, Infinity) become '#', so such
# text fails the cast. One translate and one cast stay cheap when a pushed-down filter repeats them.
_LETTERS, _BLOCKED = "dDfFxXnNiI", "##########"


def clean_number(c: Column) -> Column:
    """Text to double, commas and spaces removed; null tokens, blanks and other text become null."""
    return F.translate(c.cast("string"), _LETTERS + ", ", _BLOCKED).try_cast("double")


def clean_price(c: Column, low: float = K.PRICE_RANGE[0], high: float = K.PRICE_RANGE[1]) -> Column:
    """As clean_number, and null outside the plausible range."""
    value = clean_number(c)
    return F.when(value.between(low, high), value)


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Serving form: anything unusable becomes the default; separators are not stripped."""
    return F.coalesce(F.translate(c.cast("string"), _LETTERS, _BLOCKED).try_cast("double"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    """Serving form, truncated toward zero."""
    return F.coalesce(safe_float(c, float(default)).try_cast("bigint"), F.lit(default))


def digits_to_int(c: Column) -> Column:
    """All digits of the text as one integer: '120.5' gives 1205."""
    return F.regexp_replace(c, UNICODE + r"\D", "").try_cast("bigint")


def decimal_to_int(c: Column) -> Column:
    """Digits with a decimal point kept, commas dropped, truncated: '4,100.7' gives 4100."""
    kept = F.replace(F.regexp_replace(c, r"[^\d.,]", ""), F.lit(","), F.lit(""))
    return kept.try_cast("double").try_cast("bigint")


def first_int(c: Column) -> Column:
    """First run of digits."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("int")


def first_number(c: Column) -> Column:
    """First number with an optional decimal part: '150 m2' gives 150."""
    return F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def answer_number(c: Column) -> Column:
    """Number answered in free form: commas stripped, else null."""
    return F.translate(c, _LETTERS + ",", _BLOCKED).try_cast("double")


def digit_string_int(c: Column) -> Column:
    """Form field: an integer only when the text is all digits."""
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int"))


def thousands(c: Column) -> Column:
    """Number with thousands separators, no decimals."""
    return F.format_number(c, 0)
