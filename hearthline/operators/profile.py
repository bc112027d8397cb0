"""Data-quality profiles; each is one aggregate pass unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.numbers import clean_number
from hearthline.functions.text import strip
from hearthline.operators.ranking import null_safe_join, quantiles


def _rows_from_columns(wide: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per struct entry."""
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: type, null count, null percentage."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    wide = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("__n")), F.lit(0.0))
    return _rows_from_columns(wide, [
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                 F.col(c).alias("null_count"), pct(c).alias("null_pct"), F.col("__n").alias("n_rows"))
        for c in cols
    ])


def enrichment_needs(df: DataFrame, wanted: list[str], limit_pct: float = 20.0) -> DataFrame:
    """Wanted features with their gap; absent ones count as fully null."""
    present = [c for c in wanted if c in df.columns]
    full = df.select(*present, *[F.lit(None).cast("string").alias(c) for c in wanted if c not in present])
    return null_profile(full, wanted).select(
        "column_name",
        F.col("column_name").isin(present).alias("present") if present else F.lit(False).alias("present"),
        "null_count", "null_pct",
        ((F.col("null_pct") > limit_pct) | ~F.col("column_name").isin(present)).alias("needs_extraction"),
    )


def compare_profiles(before: DataFrame, after: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null share before and after, improvement in points; one row per column of either side."""
    b = null_profile(before, cols).select("column_name", F.col("null_pct").alias("before_pct"), F.col("null_count").alias("before_nulls"))
    a = null_profile(after, cols).select("column_name", F.col("null_pct").alias("after_pct"), F.col("null_count").alias("after_nulls"))
    return b.join(a, "column_name", "full_outer").withColumn("improvement", F.col("before_pct") - F.col("after_pct"))


def top_improvements(before: DataFrame, after: DataFrame, cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """The n columns whose null share fell most."""
    gained = compare_profiles(before, after, cols).where(F.col("improvement") > 0)
    return gained.orderBy(F.desc("improvement"), "column_name").limit(n)


def filled_cells(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Total non-null cells before and after and the gain in percent."""
    count = lambda df, name: null_profile(df, cols).agg(F.sum(F.col("n_rows") - F.col("null_count")).alias(name))
    both = count(before, "cells").withColumn("side", F.lit("b")).unionByName(count(after, "cells").withColumn("side", F.lit("a")))
    total = both.agg(F.max(F.when(F.col("side") == "b", F.col("cells"))).alias("filled_before"),
                     F.max(F.when(F.col("side") == "a", F.col("cells"))).alias("filled_after"))
    return total.withColumn(
        "gain_pct", F.try_divide((F.col("filled_after") - F.col("filled_before")) * 100.0, F.col("filled_before"))
    )


def value_counts(df: DataFrame, c: str, n: int | None = None) -> DataFrame:
    """Counts of non-null values, largest first, ties by value; top n when given."""
    counted = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    ordered = counted.orderBy(F.desc("n"), F.asc(c))
    return ordered.limit(n) if n else ordered


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """Counts with their share of all non-null rows in percent."""
    known = df.where(F.col(c).isNotNull())
    total = known.agg(F.count("*")).scalar()
    counted = known.groupBy(c).agg(F.count("*").alias("n"))
    return counted.withColumn("share_pct", F.try_divide(F.col("n") * 100.0, total))


def top_values(df: DataFrame, c: str, n: int) -> list[str]:
    """The n most frequent values, for building indicator columns; n is the driver bound."""
    return [r[0] for r in value_counts(df, c, n).collect()]


def numeric_summary(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, min, max, mean and exact median per column (and group)."""
    by = by or []
    stats = {"n": F.count, "min_value": F.min, "max_value": F.max, "mean_value": F.avg}
    wide = df.groupBy(*by).agg(*[fn(F.col(c).cast("double")).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols
    ])
    long = wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")
    medians = quantiles(df, cols, [0.5], by).withColumnRenamed("value", "median_value").drop("prob")
    return null_safe_join(long, medians, [*by, "column_name"], "left")


def dirty_numbers(df: DataFrame, c: str) -> DataFrame:
    """How many values of a text column are null, 'nan', blank, zero, convertible or bad."""
    text = F.lower(strip(F.col(c)))
    value = clean_number(F.col(c))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(c).isNull()).alias("n_null"),
        F.count_if(text == "nan").alias("n_nan_text"),
        F.count_if(text == "").alias("n_blank"),
        F.count_if(value == 0).alias("n_zero"),
        F.count_if(value.isNotNull()).alias("n_convertible"),
        F.count_if(value.isNull() & F.col(c).isNotNull()).alias("n_bad"),
    )


def bad_number_sample(df: DataFrame, c: str, n: int = 10) -> DataFrame:
    """Up to n distinct unconvertible values, in order."""
    bad = df.where(clean_number(F.col(c)).isNull() & F.col(c).isNotNull())
    return bad.select(c).distinct().orderBy(c).limit(n)


def format_census(df: DataFrame, c: str) -> DataFrame:
    """How often a raw column holds a list, an object, plain text or nothing."""
    kind = (
        F.when(F.col(c).isNull(), "null").when(F.ltrim(c).startswith("["), "list")
        .when(F.ltrim(c).startswith("{"), "object").otherwise("text")
    )
    return df.groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value as text) pairs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("e")).select("e.*")


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values of each column."""
    return _long(df, cols).where(F.col("value").isNotNull()).distinct()


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column. The exact form shuffles distinct values, not rows."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return _rows_from_columns(wide, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in cols])
    counted = distinct_values(df, cols).groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(counted, "column_name", "left").na.fill(0, ["n_distinct"])


def column_kinds(df: DataFrame, cols: list[str]) -> DataFrame:
    """binary (up to 2 values), categorical (up to 10, or not numeric), else numeric."""
    numeric = [c for c, t in df.select(*cols).dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    kind = (
        F.when(~F.col("column_name").isin(numeric or [""]), "categorical")
        .when(F.col("n_distinct") <= 2, "binary").when(F.col("n_distinct") <= 10, "categorical").otherwise("numeric")
    )
    return distinct_counts(df, cols).withColumn("kind", kind)


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row; rows are compared by a 256-bit digest of their JSON."""
    digest = F.sha2(F.to_json(F.struct(*(cols or df.columns)), {"ignoreNullFields": "false"}), 256)
    groups = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def removal_funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each rule, in order; a rule keeps rows where it is true."""
    kept = F.lit(True)
    aggs, entries = [F.count("*").alias("s0")], [("Initial", "s0")]
    for i, (name, rule) in enumerate(rules, 1):
        kept = kept & F.coalesce(rule, F.lit(False))
        aggs.append(F.count_if(kept).alias(f"s{i}"))
        entries.append((name, f"s{i}"))
    return _rows_from_columns(df.agg(*aggs), [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.col(c).alias("n_left"))
        for i, (name, c) in enumerate(entries)
    ])


def nonzero_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null and non-zero counts per feature."""
    wide = df.agg(*[F.count(c).alias(f"{c}__n") for c in cols], *[F.count_if(F.col(c) != 0).alias(f"{c}__z") for c in cols])
    return _rows_from_columns(wide, [
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__z").alias("n_nonzero")) for c in cols
    ])


def score_distribution(df: DataFrame, c: str, high: float = 7) -> DataFrame:
    """Mean, range and count above ``high`` of a score."""
    return df.agg(F.avg(c).alias("mean_score"), F.min(c).alias("min_score"), F.max(c).alias("max_score"),
                  F.count_if(F.col(c) > high).alias("n_high"))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Complete rows, all rows and their ratio in percent."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count_if(complete).alias("n_complete"), F.count("*").alias("n_rows")).withColumn(
        "complete_pct", F.try_divide(F.col("n_complete") * 100.0, F.col("n_rows"))
    )


def null_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often each combination of missing columns occurs (1 = missing)."""
    return df.groupBy(*[F.col(c).isNull().cast("int").alias(c) for c in cols]).agg(F.count("*").alias("n"))


def null_matrix(df: DataFrame, key: str, cols: list[str], n: int = 100) -> DataFrame:
    """Missing flags of the first n rows by key."""
    return df.orderBy(key).limit(n).select(key, *[F.col(c).isNull().cast("int").alias(c) for c in cols])


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes its right edge. Empty bins show 0."""
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n long")
    low, high = float(low), float(high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(c).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (low + F.col("id") * width).alias("bin_start"), (low + (F.col("id") + 1) * width).alias("bin_end"))
    return grid.join(counted, "bin", "left").na.fill(0, ["n"])


def box_stats(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Quartiles, 1.5 IQR bounds, whiskers and outlier count per group."""
    q = quantiles(df, [c], [0.25, 0.5, 0.75], by)
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    iqr = F.col("q3") - F.col("q1")
    bounds = (
        q.groupBy(*by).agg(pick(0.25).alias("q1"), pick(0.5).alias("median_value"), pick(0.75).alias("q3"))
        .withColumn("lower_bound", F.col("q1") - 1.5 * iqr).withColumn("upper_bound", F.col("q3") + 1.5 * iqr)
    )
    inside = F.col(c).between(F.col("lower_bound"), F.col("upper_bound"))
    names = ["q1", "median_value", "q3", "lower_bound", "upper_bound"]
    return (
        null_safe_join(df.select(*by, c).where(F.col(c).isNotNull()), bounds, by)
        .groupBy(*by, *names)
        .agg(F.count("*").alias("n"), F.min(F.when(inside, F.col(c))).alias("whisker_low"),
             F.max(F.when(inside, F.col(c))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    )


def token_cost(df: DataFrame, tokens_per_row: int = 800, price_per_1000: float = 0.0001) -> DataFrame:
    """Rows to send out, their tokens and the estimated cost."""
    return df.agg(F.count("*").alias("n_requests")).withColumn(
        "n_tokens", F.col("n_requests") * tokens_per_row
    ).withColumn("cost", F.col("n_tokens") / 1000.0 * price_per_1000)


def group_features(names: list[str], patterns: dict[str, str]) -> dict[str, list[str]]:
    """Feature names by the first pattern each one contains; the rest is 'other'."""
    out: dict[str, list[str]] = {g: [] for g in [*patterns, "other"]}
    for name in names:
        out[next((g for g, p in patterns.items() if p in name), "other")].append(name)
    return out
