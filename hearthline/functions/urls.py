"""URL normalisation, query parameters and page-URL generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _SPLIT, group)


def _path(c: Column) -> Column:
    return F.regexp_replace(_part(c, 3), "/+$", "")


def normalize_strict(c: Column) -> Column:
    """https, lower-case host, no trailing slash, query or fragment."""
    return F.concat(F.lit("https://"), F.lower(_part(c, 2)), _path(c))


def absolute(c: Column, base: Column) -> Column:
    """Resolve root-relative and scheme-relative links against the page they were found on."""
    scheme = F.coalesce(F.nullif(_part(base, 1), F.lit("")), F.lit("https"))
    root = F.concat(scheme, F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    return (
        F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c)
        .when(c.startswith("//"), F.concat(scheme, F.lit(":"), c))
        .when(c.startswith("/"), F.concat(root, c))
        .when(c.startswith("?") | c.startswith("#"), F.concat(root, _part(base, 3), c))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), c))
    )


def normalize_keep_query(c: Column, base: Column | None = None) -> Column:
    """Lower-case scheme and host, no trailing slash or fragment; the query stays."""
    url = absolute(c, base) if base is not None else c
    scheme = F.lower(F.coalesce(F.nullif(_part(url, 1), F.lit("")), F.lit("https")))
    query = _part(url, 4)
    suffix = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.when(
        (c != ""), F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), _path(url), suffix)
    )


def set_query_param(c: Column, name: str, value: Column) -> Column:
    """Replace a parameter in place at its first position, or append it; the fragment stays."""
    pair = F.concat(F.lit(name + "="), value.cast("string"))
    base = F.regexp_extract(c, r"^[^?#]*", 0)
    fragment = F.regexp_extract(c, r"#.*$", 0)
    pairs = F.filter(F.split(_part(c, 4), "&"), lambda p: p != "")
    first = F.array_position(F.transform(pairs, lambda p: p.startswith(name + "=")), F.lit(True))
    kept = F.filter(pairs, lambda p, i: ~p.startswith(name + "=") | (i + 1 == first))
    replaced = F.transform(kept, lambda p: F.when(p.startswith(name + "="), pair).otherwise(p))
    final = F.when(first > 0, replaced).otherwise(F.array_append(pairs, pair))
    return F.concat(base, F.lit("?"), F.array_join(final, "&"), fragment)


def page_urls(df: DataFrame, url: Column, pages: Column, out: str = "page_url") -> DataFrame:
    """One row per index page 1..n, with ``page`` set as a query parameter."""
    return df.withColumn("page", F.explode(F.sequence(F.lit(1), pages))).withColumn(
        out, set_query_param(url, "page", F.col("page"))
    )


def path_page_url(base: Column, page: Column) -> Column:
    """Path form: page 1 is the base itself, later pages append /pag-n."""
    return F.when(page <= 1, base).otherwise(F.concat(base, F.lit("/pag-"), page.cast("string")))


def listing_id(c: Column) -> Column:
    """Number before .html at the end of the URL."""
    return F.nullif(F.regexp_extract(c, r"/(\d+)\.html?$", 1), F.lit(""))


def with_scheme(c: Column) -> Column:
    """https:// in front of URLs without a scheme."""
    trimmed = F.trim(c)
    return F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
