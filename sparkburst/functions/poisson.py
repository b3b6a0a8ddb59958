"""Poisson probabilities and tails from built-in functions, for any mean and count."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_S = 365.25 * 86_400
#: Below this count ln n! is read from a table, from here on it is Stirling's series (error under 1e-16).
_TABLE = 16
#: Terms of a series below exp(-_FLAT) of its first one no longer change a double.
_FLAT = 40.0


def log_pmf(mean: Column, count: Column) -> Column:
    """ln P(X = count) for a mean above 0. Large counts go by deviance, so that nothing large is subtracted."""
    n = count.cast("double")
    small = n * F.log(mean) - mean - F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_TABLE)]), F.least(count, F.lit(_TABLE - 1)).cast("int") + 1)
    x = F.greatest(n, F.lit(float(_TABLE)))
    rest = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(count < _TABLE, small).otherwise(x * F.log(mean / x) + (x - mean) - 0.5 * F.log(2 * math.pi * x) - rest)


def _series(terms: Column, ratio: Callable[[Column], Column]) -> Column:
    """1 + r(1) + r(1) r(2) + ... with so many terms beside the first."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, m: Column) -> Column:
        term = acc["term"] * ratio(m)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1)).cast("int")), start, add, lambda a: a["sum"])
    return F.when(terms < 1, F.lit(1.0)).otherwise(total)


def log_sf(mean: Column, count: Column) -> Column:
    """ln P(X > count), for 0 < mean < count + 1: the first term's logarithm and a series of falling ratios.

    With a = count + 2, the product of m ratios mean / (a + i) is at most exp(-m ln(a / mean)), exp(-m^2 ln 2 / 2a) for
    m up to a, and halves with every further m: so the number of terms that matter is known beforehand.
    """
    a = count.cast("double") + 2
    terms = F.ceil(F.least(F.sqrt(2 * _FLAT / math.log(2) * a), a + 2 * _FLAT, F.try_divide(F.lit(_FLAT), F.log(F.try_divide(a, mean))))) + 1
    return log_pmf(mean, count + 1) + F.log(_series(terms, lambda m: mean / (a + (m - 1))))


def log_sf_floor(mean: Column, count: Column) -> Column:
    """A closed lower bound of ln P(X > count), from its first four terms: where this is too large, so is the tail."""
    a = count.cast("double") + 2
    return log_pmf(mean, count + 1) + F.log(1 + mean / a * (1 + mean / (a + 1) * (1 + mean / (a + 2))))


def log_cdf(mean: Column, count: Column) -> Column:
    """ln P(X <= count), for mean >= count + 1: the last term's logarithm and a series of falling ratios."""
    n = count.cast("double")
    terms = F.ceil(F.least(n, F.sqrt(2 * _FLAT * n), F.try_divide(F.lit(_FLAT), F.log(F.try_divide(mean, n))))) + 1
    return log_pmf(mean, count) + F.log(_series(F.least(terms, n), lambda m: (n - (m - 1)) / mean))


def sf(mean: Column, count: Column) -> Column:
    """P(X > count); no events expected and none seen give 0, and seen give 1. The smaller side is summed, so tails keep their digits."""
    return F.when(mean == 0, F.when(count == 0, 0.0).otherwise(1.0)).when(mean < count + 1, F.exp(log_sf(mean, count))).otherwise(1.0 - F.exp(log_cdf(mean, count)))


def search_sf(mean: Column, count: Column) -> Column:
    """The search's tail: without background nothing is improbable."""
    return F.when(mean <= 0, 1.0).otherwise(sf(mean, count))


def isf(p: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) >= 1 - p. Null where doubles can't tell: p of 0 or less, or so small that the sum never reaches 1 - p.

    For p under 1/2 the sum starts just below the mean, else at 0. By Bernstein's inequality k exceeds the mean by
    ln(1/p) / 3 and the root of its square and twice mean ln(1/p) at most, so the steps are known beforehand; no k is cut off.
    """

    def solved(x: Column) -> Column:
        p, mean = x["p"], x["mean"]
        low = F.when(p < 0.5, F.greatest(F.floor(mean) - 1, F.lit(0))).otherwise(0).cast("int")
        start = F.struct(low.alias("k"), F.exp(log_cdf(mean, low)).alias("cdf"), log_pmf(mean, low).alias("log"))

        def step(a: Column, k: Column) -> Column:
            log, go = a["log"] + F.log(mean / k), a["cdf"] < 1.0 - p
            return F.struct(F.when(go, k).otherwise(a["k"]).alias("k"), F.when(go, a["cdf"] + F.exp(log)).otherwise(a["cdf"]).alias("cdf"), F.when(go, log).otherwise(a["log"]).alias("log"))

        far = F.greatest(-F.log(p), F.lit(0.0))
        most = F.ceil(mean + far / 3 + F.sqrt(far * far / 9 + 2 * mean * far)) + 2
        return F.aggregate(F.sequence(low + 1, most.cast("int")), start, step, lambda a: F.when(a["cdf"] >= 1.0 - p, a["k"]))

    return F.transform(F.array(F.struct(p.alias("p"), mean.alias("mean"))), solved)[0].cast("long")


def per_year(sf_: Column, duration_s: Column) -> Column:
    """Expected false positives a year; null where the duration is 0."""
    return F.try_divide(sf_ * YEAR_S, duration_s)


def threshold(limit_per_year: float, duration_s: Column) -> Column:
    return F.lit(limit_per_year) * duration_s / YEAR_S


def at_least(n: int, chances: Column) -> Column:
    """Probability that n or more of independent events happen, given an array of theirs; any order of them gives the same.

    One pass over the array holds the probabilities of 0 to n or more so far. A null chance gives null; no events at all
    reach n only if n is 0.
    """

    def after(held: Column, p: Column) -> Column:
        return F.transform(held, lambda x, k: F.when(k == n, x + p * F.coalesce(F.get(held, k - 1), F.lit(0.0))).otherwise((1 - p) * x + p * F.coalesce(F.get(held, k - 1), F.lit(0.0))))

    if n <= 0:
        return F.aggregate(chances, F.lit(1.0), lambda a, p: F.when(p.isNotNull(), a))
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), n))
    return F.when(~F.exists(chances, lambda p: p.isNull()), F.get(F.aggregate(chances, start, after), F.lit(n)))
