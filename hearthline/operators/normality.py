"""Normality of a column from ordered values: Shapiro-Wilk and Shapiro-Francia, and the points of a Q-Q plot.

Both statistics weigh the i-th smallest value by the expected i-th smallest of as many normal draws. Ranks come from value ranges, equal values are one
row with a run of ranks, and long runs are cut into pieces, so that neither a sort nor a frequent value meets in one task.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Row, functions as F

from hearthline.operators.ranking import ranked_values

#: Ranks of one run that are handled in one row.
RUN = 4096

# --- fixed values: rational approximations of the normal quantile (Wichura, algorithm AS 241, PPND16) -------------------
QUANTILE_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
QUANTILE_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
QUANTILE_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
# --- fixed values: corrections and normalising fits of the statistics (Royston, algorithm AS R94 and 1993) ---------------
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND_LAST_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
WILK_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
WILK_SMALL_LOG_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
WILK_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
WILK_LOG_DEVIATION = (-0.4803, -0.082676, 0.0030302)


def polynomial(coefficients: tuple[float, ...], x):
    """c0 + c1 x + c2 x^2 ..., of a column or a number."""
    return reduce(lambda rest, c: rest * x + c, reversed(coefficients[:-1]), coefficients[-1])


def normal_quantiles(ps: Column) -> Column:
    """The normal quantiles of an array of shares in (0, 1), to double precision; other values give null."""
    ratio = lambda fit, x: polynomial(fit[0], x) / polynomial(fit[1], x)
    # What the formulas share is computed once for each value.
    parts = F.transform(ps, lambda p: F.struct((p - 0.5).alias("q"), F.sqrt(-F.ln(F.least(p, 1 - p))).alias("t")))

    def quantile(s: Column) -> Column:
        q, t = s["q"], s["t"]
        outer = F.when(t <= 5, ratio(QUANTILE_NEAR, t - 1.6)).otherwise(ratio(QUANTILE_FAR, t - 5.0))
        return F.when(t.isNotNull(), F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * outer))

    return F.transform(parts, quantile)


def normal_quantile(p: Column) -> Column:
    return F.get(normal_quantiles(F.array(p)), F.lit(0))


def rank_runs(df: DataFrame, c: str, run: int = RUN) -> DataFrame:
    """(value, n_total, first, last): every distinct value with its ranks, in pieces of at most ``run`` ranks, dealt out evenly."""
    ranked = ranked_values(df, c)
    starts = F.sequence(F.col("rows_before") + 1, F.col("rows_before") + F.col("n_rows"), F.lit(run).cast("long"))
    pieces = ranked.select(F.col(c).alias("value"), "n_total", (F.col("rows_before") + F.col("n_rows")).alias("end"), F.explode(starts).alias("first"))
    cut = pieces.select("value", "n_total", "first", F.least(F.col("end"), F.col("first") + run - 1).alias("last"))
    return cut.repartition("first")


def shapiro(df: DataFrame, c: str, run: int = RUN) -> DataFrame:
    """One row: n, shapiro_wilk_w, shapiro_wilk_p, shapiro_francia_w, shapiro_francia_p of the non-null values.

    W is 1 for perfectly normal order and null below 4 values or without spread; p is the chance of so small a W (Royston's fits, made for
    n up to 5,000; beyond, p is an extrapolation). NaN and infinite values are left out. A dozen sums reach the driver.
    """
    x = F.col(c).cast("double")
    values = df.select(x.alias("value")).where("value IS NOT NULL AND value - value = 0")
    runs = rank_runs(values, "value", run).crossJoin(F.broadcast(values.agg(F.avg("value").alias("mean"))))
    # Expected order statistics by Blom's shares. Values count from their mean, so that squares lose nothing.
    shares = F.transform(F.sequence("first", "last"), lambda i: (i - 0.375) / (F.col("n_total") + 0.25))
    add = lambda a, f=lambda v: v: F.aggregate(a, F.lit(0.0), lambda total, v: total + f(v))
    sums = runs.withColumn("m", normal_quantiles(shares)).select(
        "n_total", "first", "last", (F.col("last") - F.col("first") + 1).alias("k"), (F.col("value") - F.col("mean")).alias("x"),
        add(F.col("m")).alias("m"), add(F.col("m"), lambda v: v * v).alias("mm"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("x")))
    n = F.col("n_total")
    t = sums.agg(
        F.max(n).alias("n"), F.sum(F.col("x") * F.col("m")).alias("mx"), F.sum("mm").alias("mm"), F.sum(F.col("x") * F.col("k")).alias("x"),
        F.sum(F.col("x") * F.col("x") * F.col("k")).alias("xx"), *(at(rank).alias(name) for name, rank in (("x1", F.lit(1)), ("x2", F.lit(2)), ("y2", n - 1), ("y1", n)))).first()
    return df.sparkSession.createDataFrame(
        [_statistics(t)], "n long, shapiro_wilk_w double, shapiro_wilk_p double, shapiro_francia_w double, shapiro_francia_p double")


def _statistics(t: Row) -> tuple:
    n = t["n"] or 0
    spread = t["xx"] - t["x"] ** 2 / n if n else 0.0
    if n < 4 or not spread > 0:
        return n, None, None, None, None
    m1, m2 = (NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    u, norm = 1 / math.sqrt(n), math.sqrt(t["mm"])
    a1 = m1 / norm + polynomial(LAST_WEIGHT, u)
    wide, near = t["y1"] - t["x1"], t["y2"] - t["x2"]
    if n > 5:
        a2 = m2 / norm + polynomial(SECOND_LAST_WEIGHT, u)
        rest = (t["mm"] - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2)
        weighed = a1 * wide + a2 * near + (t["mx"] - m1 * wide - m2 * near) / math.sqrt(rest)
    else:
        rest = (t["mm"] - 2 * m1**2) / (1 - 2 * a1**2)
        weighed = a1 * wide + (t["mx"] - m1 * wide) / math.sqrt(rest)
    w, francia = min(1.0, weighed**2 / spread), min(1.0, t["mx"] ** 2 / (t["mm"] * spread))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    log_n = math.log(n)
    if w == 1:
        p = 1.0
    elif n <= 11:
        far = 0.459 * n - 2.273 - math.log(1 - w)
        p = tail((-math.log(far) - polynomial(WILK_SMALL_MEAN, n)) / math.exp(polynomial(WILK_SMALL_LOG_DEVIATION, n))) if far > 0 else 0.0
    else:
        p = tail((math.log(1 - w) - polynomial(WILK_MEAN, log_n)) / math.exp(polynomial(WILK_LOG_DEVIATION, log_n)))
    v = math.log(log_n)
    f_p = 1.0 if francia == 1 else tail((math.log(1 - francia) - (-1.2725 + 1.0521 * (v - log_n))) / (1.0308 - 0.26758 * (v + 2 / log_n)))
    return n, w, p, francia, f_p
