"""Normal quantiles and the Shapiro statistics against the definitions and published examples."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import normality


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.9251, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normality.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) <= 1e-13 * max(1, abs(r.z)) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,), (-0.5,)], "p double").select(normality.normal_quantile(F.col("p"))).collect()
    assert all(r[0] is None for r in odd)


def blom(n):
    return np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])


def wilk(x):
    x, n = np.sort(np.array(x, float)), len(x)
    m, u = blom(n), 1 / math.sqrt(n)
    poly = lambda cs: sum(c * u**i for i, c in enumerate(cs))
    a = m.copy()
    last = m[-1] / math.sqrt(m @ m) + poly(normality.LAST_WEIGHT)
    if n > 5:
        second = m[-2] / math.sqrt(m @ m) + poly(normality.SECOND_LAST_WEIGHT)
        phi = (m @ m - 2 * m[-1]**2 - 2 * m[-2]**2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[[1, -2]] = -second, second
    else:
        a = m / math.sqrt((m @ m - 2 * m[-1]**2) / (1 - 2 * last**2))
    a[[0, -1]] = -last, last
    return (a @ x)**2 / ((x - x.mean())**2).sum(), (m @ x)**2 / ((m @ m) * ((x - x.mean())**2).sum())


RNG = np.random.default_rng(8)
SAMPLES = {"normal": RNG.normal(1e6, 3, 500), "skewed": RNG.exponential(1, 300), "ties": RNG.integers(0, 4, 900), "four": [1, 2, 4, 9], "five": [3, 1, 4, 1, 5], "six": [3, 1, 4, 1, 5, 9],
           "one value mostly": [0.0] * 400 + [1.0] * 3}


@pytest.mark.parametrize("run", [3, 4096])
@pytest.mark.parametrize("name", SAMPLES)
def test_statistics_equal_their_definition(spark, name, run):
    x = [float(v) for v in SAMPLES[name]]
    r = normality.shapiro(spark.createDataFrame([(v,) for v in x] + [(None,), (math.nan,), (math.inf,)], "v double"), "v", run).first()
    w, f = wilk(x)
    assert r.n == len(x) and abs(r.shapiro_wilk_w - w) < 1e-9 and abs(r.shapiro_francia_w - f) < 1e-9
    assert 0 <= r.shapiro_wilk_p <= 1 and (r.shapiro_wilk_p > 0.01) == (name in ("normal", "four", "five", "six"))


def test_published_example(spark):
    """Weights of eleven men, the textbook example of the test: W = 0.79 and p below 0.01."""
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = normality.shapiro(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    assert abs(r.shapiro_wilk_w - 0.79) < 0.005 and 0.005 < r.shapiro_wilk_p < 0.01


def test_without_spread_or_values(spark):
    for x in ([], [1.0, 2.0, 3.0], [5.0] * 20):
        r = normality.shapiro(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
        assert r.shapiro_wilk_w is None and r.shapiro_wilk_p is None and r.shapiro_francia_w is None
