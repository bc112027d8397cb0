"""Exact order statistics, at every size by the same route.

Quantiles of groups: values are cut into ranges along an approximate grid, range counts give every range's first rank, and only
the ranges that hold a wanted rank are counted value by value. Quantiles of whole columns: a sketch gives bounds around every wanted rank,
one pass counts below and between them, and only the values between are counted one by one; bounds that hold too many are drawn
closer first. Nulls are left out; NaN counts as the largest value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.session import materialize

# A value range should hold about this many rows; the number of ranges grows with the data.
RANGE_ROWS = 1_000_000
# Ranks from a sketch are off by at most the rows divided by this; the size of a sketch does not depend on the rows.
ACCURACY = 2_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal; keys come from the left side."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _ranges(df: DataFrame, cols: list[str], ranges: int) -> DataFrame:
    """Adds ``__range_<c>`` to every column: index of its value range; equal values always share a range, NaN has the last one."""
    grid = lambda c, n: F.percentile_approx(c, [i / n for i in range(1, n)], n * 20)
    n_rows, *edges = df.agg(F.count("*"), *[grid(c, ranges) for c in cols]).first()
    wanted = n_rows // RANGE_ROWS
    if wanted > ranges:
        edges = df.agg(*[grid(c, wanted) for c in cols]).first()
    splits = [[-math.inf, *sorted({float(x) for x in e or [0.0] if math.isfinite(x)} or {0.0}), math.inf] for e in edges]
    names = [f"__range_{c}" for c in cols]
    return Bucketizer(splitsArray=splits, inputCols=cols, outputCols=names, handleInvalid="keep").transform(df)


def _before(w, c: str) -> Column:
    """Running total up to the previous row."""
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _range_offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """First rank of every range per group, from (by..., __range, __n) rows: at most groups x ranges."""
    w = Window.partitionBy(*by).orderBy("__range")
    offsets = counts.withColumn("__offset", _before(w, "__n")).withColumn(
        "__total", F.sum("__n").over(Window.partitionBy(*by))
    )
    return offsets if by else F.broadcast(offsets)  # without groups there are only the ranges


def ranked_values(df: DataFrame, value: str, by: list[str] | None = None, ranges: int = 256) -> DataFrame:
    """Distinct values with ``n_rows``, ``rows_before`` and ``n_total`` per group.

    Ties are counted before anything is sorted, so a value held by a third of the rows is one row.
    """
    by = by or []
    given = df.select(*by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    ranged = _ranges(given, [value], ranges).withColumnRenamed(f"__range_{value}", "__range")
    counts = ranged.groupBy(*by, "__range", value).agg(F.count("*").alias("n_rows"))
    offsets = _range_offsets(counts.groupBy(*by, "__range").agg(F.sum("n_rows").alias("__n")), by).drop("__n")
    inner = _before(Window.partitionBy(*by, "__range").orderBy(value), "n_rows")
    return (
        null_safe_join(counts.withColumn("__inner", inner), offsets, [*by, "__range"])
        .select(*by, value, "n_rows", (F.col("__offset") + F.col("__inner")).alias("rows_before"),
                F.col("__total").alias("n_total"))
    )


def _by_range(ranged: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """(by..., prob, value) from (by..., __range, value) rows."""
    position = (F.col("__total") - 1) * F.col("prob")
    has = lambda k, start, size: (k >= start) & (k < start + size)
    targets = (
        _range_offsets(ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n")), by)
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("__pos", position)
        .withColumn("__lo", F.floor("__pos")).withColumn("__hi", F.ceil("__pos"))
        .where(has(F.col("__lo"), F.col("__offset"), F.col("__n"))
               | has(F.col("__hi"), F.col("__offset"), F.col("__n")))
        .drop("__n", "__total")
    )
    keys = [*by, "__range"]
    wanted = null_safe_join(ranged, targets.select(*keys).distinct(), keys, "left_semi")
    counts = wanted.groupBy(*keys, "value").agg(F.count("*").alias("__n"))
    inner = _before(Window.partitionBy(*keys).orderBy("value"), "__n")
    start = F.col("__offset") + F.col("__inner")
    pick = lambda k: F.max(F.when(has(F.col(k), start, F.col("__n")), F.col("value")))
    between = F.when(F.col("__pos") == F.col("__lo"), F.col("__lov")).otherwise(
        F.col("__lov") + (F.col("__hiv") - F.col("__lov")) * (F.col("__pos") - F.col("__lo")))
    return (
        null_safe_join(counts.withColumn("__inner", inner), targets, keys)
        .groupBy(*by, "prob", "__pos", "__lo").agg(pick("__lo").alias("__lov"), pick("__hi").alias("__hiv"))
        .select(*by, "prob", between.alias("value"))
    )


@dataclass
class _Rank:
    """Two neighbouring ranks of a column that are wanted, and bounds of their values."""

    column: str
    first: int
    last: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0

    def between(self) -> Column:
        c = F.col(self.column)
        return (c >= self.low) & (c <= self.high) & ~F.isnan(c)


def _count(df: DataFrame, ranks: list[_Rank]) -> None:
    """Values below and between the bounds; bounds that miss their ranks are opened."""
    row = df.agg(*(x.alias(f"{n}{i}") for i, r in enumerate(ranks) for n, x in (("b", F.count_if(F.col(r.column) < r.low)), ("i", F.count_if(r.between()))))).first()
    missed = []
    for i, r in enumerate(ranks):
        r.below, r.inside = row[f"b{i}"], row[f"i{i}"]
        if not r.below <= r.first <= r.last < r.below + r.inside:
            r.low, r.high = -math.inf, math.inf
            missed.append(r)
    if missed:
        _count(df, missed)


def _ranked(df: DataFrame, ranks: list[_Rank]) -> dict[tuple[str, int], float]:
    """(column, rank) -> value, ranks from 0 among the values that aren't NaN."""
    if not ranks:
        return {}
    _count(df, ranks)
    wide = ranks
    while wide := [r for r in wide if r.inside > RANGE_ROWS and r.low < r.high]:
        shares = lambda r: [min(1.0, max(0.0, (k - r.below) / r.inside + d)) for k, d in ((r.first, -2 / ACCURACY), (r.last, 2 / ACCURACY))]
        row = df.agg(*(F.percentile_approx(F.when(r.between(), F.col(r.column)), shares(r), ACCURACY).alias(str(i)) for i, r in enumerate(wide))).first()
        before = [(r.low, r.high) for r in wide]
        for r, bounds in zip(wide, row):
            r.low, r.high = bounds
        _count(df, wide)
        wide = [r for r, b in zip(wide, before) if (r.low, r.high) != b]  # bounds that stay hold few values, often
    entries = F.filter(F.array(*(F.when(r.between(), F.struct(F.lit(i).alias("nr"), F.col(r.column).alias("value"))) for i, r in enumerate(ranks))), lambda e: e.isNotNull())
    counts = df.select(F.explode(entries).alias("e")).groupBy("e.nr", "e.value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("nr").orderBy("value"))
    start = F.element_at(F.array(*(F.lit(r.below) for r in ranks)), F.col("nr") + 1)
    wanted = lambda name: F.element_at(F.array(*(F.lit(getattr(r, name)) for r in ranks)), F.col("nr") + 1)
    placed = counts.select("nr", "value", (start + upto - F.col("n")).alias("from"), (start + upto).alias("to")).where(
        (F.col("to") > wanted("first")) & (F.col("from") <= wanted("last")))
    found: dict[tuple[str, int], float] = {}
    for r in placed.collect():  # at most two values of each wanted rank
        for k in (ranks[r["nr"]].first, ranks[r["nr"]].last):
            if r["from"] <= k < r["to"]:
                found[ranks[r["nr"]].column, k] = r["value"]
    return found


def _whole_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """(column, probability) -> interpolated quantile of double columns."""
    shares = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)})
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    row = df.agg(*(x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.count(known[c]).alias(f"k{i}"), F.percentile_approx(known[c], shares, ACCURACY).alias(f"s{i}")))).first()
    ranks: dict[tuple[str, int, int], _Rank] = {}
    for i, c in enumerate(cols):
        at = dict(zip(shares, row[f"s{i}"] or []))
        for p in probs:
            position = (row[f"n{i}"] - 1) * p
            first, last = math.floor(position), min(math.ceil(position), row[f"k{i}"] - 1)
            if 0 <= first <= last:
                ranks[c, first, last] = _Rank(c, first, last, at[max(0.0, p - 2 / ACCURACY)], at[min(1.0, p + 2 / ACCURACY)])
    found = _ranked(df, list(ranks.values()))
    out: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(cols):
        n, k = row[f"n{i}"], row[f"k{i}"]
        for p in probs:
            position = (n - 1) * p
            low, high = (None if not n else found[c, r] if r < k else math.nan for r in (math.floor(position), math.ceil(position)))
            out[c, p] = low if not n or position == math.floor(position) else low + (high - low) * (position - math.floor(position))
    return out


def _quantile_rows(wide: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """One row per column and probability out of one array per column."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("prob"), F.get(F.col(c), F.lit(i)).alias("value"))
        for c in cols for i, p in enumerate(probs)
    ])
    return wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None, ranges: int = 256, accuracy: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles: (by..., column_name, prob, value), nulls ignored, NaN as the largest value.

    Every group has a row per column and probability, null when it has no value there; without groups so has an
    empty table. With ``accuracy`` the values are approximate (rank error 1/accuracy) and cost one pass.
    """
    by = by or []
    if accuracy:
        plist = F.array(*[F.lit(float(p)) for p in probs])
        aggs = [F.percentile_approx(F.col(c).cast("double"), plist, accuracy).alias(c) for c in cols]
        return _quantile_rows(df.groupBy(*by).agg(*aggs), cols, probs, by)
    if not by:
        values = df.select(*[F.col(c).cast("double").alias(f"__v_{c}") for c in cols]).persist()
        found = _whole_quantiles(values, [f"__v_{c}" for c in cols], [float(p) for p in probs]) if cols and probs else {}
        values.unpersist()
        rows = [(c, float(p), found[f"__v_{c}", float(p)]) for c in cols for p in probs]
        return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")
    # The needed columns only, computed once for all passes.
    narrow = materialize(df.select(*by, *[F.col(c).cast("double").alias(f"__v_{c}") for c in cols]), "quantiles")
    ranged = _ranges(narrow, [f"__v_{c}" for c in cols], ranges)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__v_{c}").alias("value"), F.col(f"__range___v_{c}").cast("int").alias("__range")) for c in cols])
    long = ranged.select(*by, F.explode(entries).alias("e")).select(*by, "e.*").where(F.col("value").isNotNull())
    found = _by_range(long, probs, [*by, "column_name"])
    groups = narrow.select(*by).distinct()
    every = groups.withColumn("column_name", F.explode(F.array(*map(F.lit, cols)))).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    return null_safe_join(every, found, [*by, "column_name", "prob"], "left").select(*by, "column_name", "prob", "value")


def quantile_values(df: DataFrame, cols: list[str], probs: list[float], **kwargs) -> dict[str, list[float | None]]:
    """Quantiles as driver values; len(cols) x len(probs) numbers."""
    rows = quantiles(df, cols, probs, **kwargs).collect()
    found = {(r["column_name"], r["prob"]): r["value"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in cols}
