"""Imputation, capping, correlation and outlier operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hearthline.operators.profile import _long, _rows_from_columns
from hearthline.operators.ranking import quantile_values
from hearthline.session import materialize


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantile_values(df, cols, [0.5]).items()}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace nulls by fitted values; columns without one stay as they are."""
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()})


def impute_median(df: DataFrame, cols: list[str], fitted: dict[str, float | None] | None = None) -> DataFrame:
    """Nulls to the exact median of the column (or to medians fitted elsewhere)."""
    return fill(df, fitted if fitted is not None else medians(df, cols))


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, ties to the smallest. Counting is distributed."""
    counted = _long(df, cols).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("b"))
    found = {r["column_name"]: r["value"] for r in best.select("column_name", "b.value").collect()}
    return {c: found.get(c) for c in cols}


def impute_mode(df: DataFrame, cols: list[str], fallback: str = "unknown") -> DataFrame:
    """Nulls of text columns to the mode, or to the fallback when the column is all null."""
    return fill(df, {c: fallback if v is None else v for c, v in modes(df, cols).items()})


def cap(df: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99,
        bounds: dict[str, list[float | None]] | None = None) -> DataFrame:
    """Clip to exact quantiles; pass fitted bounds to reuse training limits. Nulls stay null."""
    bounds = bounds or quantile_values(df, cols, [low, high])
    limits = {c: b for c, b in bounds.items() if b[0] is not None}
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in limits.items()
    })


def correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson r with the target, one pass, pairwise complete rows."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return _rows_from_columns(wide, [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"), F.abs(F.col(c)).alias("abs_corr")) for c in cols
    ])


def top_correlations(df: DataFrame, cols: list[str], target: str, n: int = 15) -> DataFrame:
    return correlations(df, cols, target).orderBy(F.desc_nulls_last("abs_corr"), "feature").limit(n)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every ordered pair of columns with its r; one pass over the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    entry = lambda a, b, name: F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(name).alias("corr"))
    entries = [entry(a, b, f"{a}__{b}") for a, b in pairs] + [entry(b, a, f"{a}__{b}") for a, b in pairs if a != b]
    return _rows_from_columns(wide, entries)


def f_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Univariate regression F per feature over complete rows."""
    complete = df.select(*cols, target).na.drop()
    wide = complete.agg(F.count("*").alias("__n"), *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    score = lambda c: F.try_divide(F.col(c) * F.col(c) * (F.col("__n") - 2), 1 - F.col(c) * F.col(c))
    return _rows_from_columns(wide, [F.struct(F.lit(c).alias("feature"), score(c).alias("f_score")) for c in cols])


def correlated_features(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Features to drop: each one too close to an earlier kept one. The matrix is cols x cols."""
    r = {(x["feature_a"], x["feature_b"]): abs(x["corr"] or 0.0) for x in correlation_matrix(df, cols).collect()}
    kept: list[str] = []
    for c in cols:
        if all(r[(k, c)] <= limit for k in kept):
            kept.append(c)
    return [c for c in cols if c not in kept]


def low_variance_features(df: DataFrame, cols: list[str], limit: float = 0.0) -> list[str]:
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is None or row[c] <= limit]


def percentile_flag(df: DataFrame, c: str, low: float = 0.01, high: float = 0.99, out: str = "outside_percentiles") -> DataFrame:
    lo, hi = quantile_values(df, [c], [low, high])[c]
    return df.withColumn(out, (F.col(c) < lo) | (F.col(c) > hi) if lo is not None else F.lit(None).cast("boolean"))


def iqr_flag(df: DataFrame, c: str, out: str = "iqr_outlier") -> DataFrame:
    q1, q3 = quantile_values(df, [c], [0.25, 0.75])[c]
    if q1 is None:
        return df.withColumn(out, F.lit(None).cast("boolean"))
    spread = 1.5 * (q3 - q1)
    return df.withColumn(out, (F.col(c) < q1 - spread) | (F.col(c) > q3 + spread))


def zscore_flag(df: DataFrame, c: str, limit: float = 3.0, out: str = "zscore_outlier") -> DataFrame:
    """More than ``limit`` sample standard deviations from the mean."""
    mean, std = df.agg(F.avg(c), F.stddev_samp(c)).first()
    if not std:
        return df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(False)))
    return df.withColumn(out, F.abs(F.col(c) - mean) > limit * std)


def outlier_flags(df: DataFrame, c: str, low: float = 0.01, high: float = 0.99, z: float = 3.0) -> DataFrame:
    """The percentile, IQR and z-score flags together, with one quantile pass and one moment pass."""
    p_lo, q1, q3, p_hi = quantile_values(df, [c], [low, 0.25, 0.75, high])[c]
    if q1 is None:
        return df.withColumns({n: F.lit(None).cast("boolean") for n in ("outside_percentiles", "iqr_outlier", "zscore_outlier")})
    spread = 1.5 * (q3 - q1)
    return zscore_flag(df, c, z).withColumns({
        "outside_percentiles": (F.col(c) < p_lo) | (F.col(c) > p_hi),
        "iqr_outlier": (F.col(c) < q1 - spread) | (F.col(c) > q3 + spread),
    })


def mean_pivot(df: DataFrame, value: str, row: str, column: str, values: list) -> DataFrame:
    """Mean of a value as a 2-D table; the pivot values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def standardize(df: DataFrame, cols: list[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Zero mean and unit population deviation, as fitted on the training rows."""
    fitted = fitted or standard_moments(df, cols)
    scaled = lambda c: F.try_divide(F.col(c) - F.lit(fitted[c][0]), F.lit(fitted[c][1] or 1.0))
    return df.withColumns({c: scaled(c) for c in cols})


def standard_moments(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def label_encode(df: DataFrame, c: str, out: str) -> DataFrame:
    """Codes 0.. by sorted value, for any number of categories; null becomes -1.

    The distinct values are sorted across tasks, counted per piece and numbered within it; nothing passes through the driver.
    """
    values = df.where(F.col(c).isNotNull()).select(c).distinct()
    # Written in order: each piece holds a range of values, and the piece numbers rise with the values.
    pieces = materialize(values.orderBy(c).select(c, F.spark_partition_id().alias("__piece")), "labels")
    sizes = pieces.groupBy("__piece").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__piece").orderBy(c))
    codes = pieces.join(sizes.withColumn("__before", before), "__piece").select(c, (F.col("__before") + within - 1).cast("int").alias(out))
    return df.join(codes, c, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1))).select(*df.columns, out)
