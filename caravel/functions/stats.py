"""Statistics as column expressions over small aggregates."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """The normal distribution by the Abramowitz-Stegun polynomial 26.2.17 (error < 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided p of the pooled two-proportion z test; null without spread."""
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return 2 * (1 - normal_cdf(F.abs((k1 / n1 - k2 / n2) / F.nullif(se, F.lit(0.0)))))


def welch_p(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Two-sided p of Welch's test by the normal distribution; null without spread."""
    se = F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)
    return 2 * (1 - normal_cdf(F.abs((m1 - m2) / F.nullif(se, F.lit(0.0)))))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval; null for no trials."""
    p, n = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high"))


def surprise(observed: Column, expected: Column, own_sd: Column) -> Column:
    """How far a count is from its expectation, in the larger of Poisson's and its own sd."""
    return (observed - expected) / F.nullif(F.greatest(F.sqrt(expected), own_sd), F.lit(0.0))


def split_change(days0: Column, rate0: Column, days1: Column, rate1: Column) -> Column:
    """The change of days x rate shared between the two, each at the other's mean."""
    return F.struct(((days1 - days0) * (rate0 + rate1) / 2).alias("days"), ((rate1 - rate0) * (days0 + days1) / 2).alias("rate"))


def decompose(vehicles0: Column, trips0: Column, vehicles1: Column, trips1: Column) -> Column:
    """Shares of a year-on-year change of trips owed to the number of vehicles and to the
    trips of each, in logarithms.
    """
    total = F.ln(trips1 / trips0)
    fleet = F.ln(vehicles1 / vehicles0)
    return F.struct(fleet.alias("vehicles"), (total - fleet).alias("intensity"), total.alias("total"))


def inverse_normal(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# The coefficients of Acklam's rational approximation of the inverse normal,
# for the middle (numerator, denominator) and the tails, highest power first.
MIDDLE = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0],
)
TAIL = (
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0],
)
TAIL_FROM = 0.02425


def polynomial(x: Column, powers: list[float]) -> Column:
    return reduce(lambda total, c: total * x + c, powers[1:], F.lit(powers[0]))


def normal_quantile(p: Column) -> Column:
    """The standard normal's value below which `p` lies, to nine digits; null outside (0, 1)."""
    low = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.ln(low))
    tail = polynomial(q, TAIL[0]) / polynomial(q, TAIL[1]) * F.when(p > 0.5, -1.0).otherwise(1.0)
    m = p - 0.5
    middle = m * polynomial(m * m, MIDDLE[0]) / polynomial(m * m, MIDDLE[1])
    return F.when((p > 0) & (p < 1), F.when(low < TAIL_FROM, tail).otherwise(middle))


def family_z(tests: Column, alpha: float = 0.05, single: float = 2.0) -> Column:
    """The two-sided z that one of `tests` findings must pass so that all of them together
    are wrong with probability `alpha` at most; `single` where there is one test or none.
    """
    return F.when(tests > 1, F.abs(normal_quantile(alpha / tests / 2))).otherwise(single)


def bonferroni_z(tests: int, alpha: float = 0.05) -> float:
    """The two-sided z that keeps `alpha` over so many tests."""
    return inverse_normal(1 - alpha / (2 * max(tests, 1)))


def ols(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2, s (residual sd), n, x_mean and sxx of y on x for each group,
    from one pass of regression aggregates.
    """
    fit = points.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0)), F.lit(0.0))
    return fit.withColumn("s", F.when(F.col("n") > 2, F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0))))).drop("syy", "sxy")


#: Student's t at 95 %, two-sided, for 1 to 30 degrees of freedom; fixed values.
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def t95(df: Column) -> Column:
    table = F.array(*map(F.lit, T95))
    return F.when(df < 1, None).when(df <= 30, F.try_element_at(table, df.cast("int"))).otherwise(1.96)


def predicted(fit: DataFrame, at: Column) -> DataFrame:
    """The fit's value at x with its 95 % prediction interval, floored at 0."""
    value = F.col("intercept") + F.col("slope") * at
    half = t95(F.col("n") - 2) * F.col("s") * F.sqrt(1 + 1 / F.col("n") + F.pow(at - F.col("x_mean"), 2) / F.nullif("sxx", F.lit(0.0)))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return fit.withColumn("value", floor(value)).withColumn("low", floor(value - half)).withColumn("high", floor(value + half))
