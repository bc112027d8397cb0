"""Date text to epoch milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(c: Column) -> Column:
    """ISO date text, with or without time, fraction and separators, read as UTC; offset or trailing Z ignored as in the source data."""
    naive = F.trim(c)
    # The offset follows a time; a date's own last part is no offset.
    parts = (r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?"
             r"(?:Z|[+-]\d{2}:?\d{2})?)?$")
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(naive, parts, i), F.lit("")), F.lit(default))
    text = F.concat(part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
                    F.lit("."), F.rpad(F.substring(part(7, "0"), 1, 6), 6, "0"), F.lit(" +00:00"))
    return F.unix_millis(F.try_to_timestamp(F.when(naive.rlike(parts), text), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS XXX")))


def ntz_epoch_ms(c: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def display_date(ms: Column) -> Column:
    """'January 01, 2022' of epoch milliseconds."""
    return F.date_format(F.date_from_unix_date((F.floor(ms / 86_400_000)).cast("int")), "MMMM dd, yyyy")
