"""Prices and currencies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline.functions.numbers import decimal_to_int, digits_to_int
from hearthline.functions.text import UNICODE_ICASE


def _price_struct(amount: Column, currency: Column) -> Column:
    return F.struct(amount.cast("bigint").alias("price"), currency.alias("currency"))


def price_and_currency(c: Column, currency_pattern: str = r"\b(?:TND|DT)\b|dinar") -> Column:
    """First number run of the text and TND when a local-currency word occurs.

    A dot is a decimal point: '250.000 DT' is 250, '1.200.000' is null.
    """
    run = F.nullif(F.regexp_extract(c, r"(?U)\d[\d\s.,]*", 0), F.lit(""))
    amount = F.regexp_replace(run, r"(?U)[\s,]", "").try_cast("double")
    currency = F.when(c.rlike(UNICODE_ICASE + currency_pattern), F.lit("TND"))
    return _price_struct(amount.try_cast("bigint"), currency)


def description_price(c: Column) -> Column:
    """'Price 4,100 TND' inside running text."""
    pattern = r"(?U)[Pp]rice\s*[:\-]?\s*([\d\s.,]+)\s*(TND|DT|dinars?)?\b"
    amount = decimal_to_int(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    unit = F.regexp_extract(c, pattern, 2)
    return _price_struct(amount, F.when(unit.rlike("(?i)TND|DT|dinar"), F.lit("TND")))


def text_price(c: Column, unit_required: bool = False) -> Column:
    """At least three digits or separators, followed by a unit; DT and no unit mean TND."""
    pattern = r"(?iU)([\d\s.,]{3,})\s*(DT|TND|EUR|€)" + (r"\b" if unit_required else "?")
    amount = digits_to_int(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    unit = F.upper(F.regexp_extract(c, pattern, 2))
    return _price_struct(amount, F.when(unit.isin("EUR", "€"), F.lit("EUR")).otherwise(F.lit("TND")))


def estate_price(e: Column) -> Column:
    """Price of an embedded estate object; private negotiation has none."""
    text = F.coalesce(F.nullif(e["price"], F.lit("")), e["costs"]["price"])
    numeric = F.when(e["numeric_price"] != 0, e["numeric_price"].try_cast("bigint"))
    from_text = digits_to_int(F.nullif(text, F.lit("")))
    euro = (
        numeric.isNull()
        & from_text.isNotNull()
        & (F.contains(text, F.lit("€")) | F.contains(F.upper(text), F.lit("EUR")))
        & ~text.rlike(r"(?iU)\bDT\b|\bDINAR")
    )
    private = F.coalesce(e["private_negotiation"], F.lit(False))
    amount = F.when(~private, F.coalesce(numeric, from_text))
    return _price_struct(
        amount, F.when(~private & F.coalesce(euro, F.lit(False)), F.lit("EUR")).otherwise(F.lit("TND"))
    )


def choose_price(transaction: Column, main: Column, described: Column) -> Column:
    """For rentals the price in the description wins; its missing unit falls back to the main one."""
    use_text = (transaction == "rent") & described["price"].isNotNull()
    return F.when(
        use_text,
        _price_struct(described["price"], F.coalesce(described["currency"], main["currency"])),
    ).otherwise(_price_struct(main["price"], main["currency"]))


def normal_currency(c: Column, default: str = "TND") -> Column:
    """TND and EUR stay; DT and everything else become the default."""
    return F.when(c.isin("TND", "EUR"), c).otherwise(F.lit(default))
