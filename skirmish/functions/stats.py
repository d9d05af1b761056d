"""Statistical column expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; (0, 0) without observations."""
    rate = wins / F.nullif(n, F.lit(0))
    scale = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / scale
    margin = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    return tuple(F.when(n <= 0, F.lit(0.0)).otherwise(x) for x in (centre - margin, centre + margin))


def shrunk_delta(wins: Column, n: Column, base: Column, strength: float = 100.0) -> Column:
    """Shift of a rate from its base, with ``strength`` pseudo-observations at the base."""
    return (wins + base * strength) / (n + strength) - base


def shrunk_rate(wins: Column, n: Column, mean: Column, strength: Column | float) -> Column:
    """Beta posterior mean for a prior of given mean and strength."""
    return (wins + mean * strength) / (n + strength)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def interval_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Intersection over union of two intervals; 1 for two equal points; null where an end is unknown."""
    union = F.greatest(high_a, high_b) - F.least(low_a, low_b)
    shared = F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))
    known = _finite(low_a) & _finite(high_a) & _finite(low_b) & _finite(high_b)
    return F.when(known & (union > 0), shared / union).when(known & (low_a == low_b), F.lit(1.0))


def comparative_margin(rate_a: Column, n_a: Column, rate_b: Column, n_b: Column, extra: float = 100.0) -> Column:
    """Half width of a 95 % interval for the difference of two rates, with pseudo-counts in the denominators."""
    a, b = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)) for r in (rate_a, rate_b))
    return Z95 * F.sqrt(a * (1 - a) / (n_a + extra) + b * (1 - b) / (n_b + extra))


def standard_error(rate: Column, n: Column) -> Column:
    return F.sqrt(rate * (1 - rate) / F.nullif(n, F.lit(0)))


def bonferroni(alpha: float, n: Column) -> Column:
    return F.lit(alpha) / F.greatest(n, F.lit(1))


def effective_support(weight: Column) -> Column:
    """Kish's effective number of observations, as an aggregate over weights."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def poisson_binomial_tail(probabilities: Column, at_least: Column) -> Column:
    """P(X >= m) for independent events: a fold over the array that convolves one event at a time."""

    def step(mass: Column, p: Column) -> Column:
        shifted = F.concat(F.array(F.lit(0.0)), mass)
        same = F.concat(mass, F.array(F.lit(0.0)))
        return F.zip_with(same, shifted, lambda stay, up: stay * (1 - p) + up * p)

    mass = F.aggregate(probabilities, F.array(F.lit(1.0)), step)
    return F.aggregate(F.slice(mass, at_least + 1, F.size(probabilities) + 1), F.lit(0.0), lambda x, y: x + y)


def clipped(p: Column, eps: float) -> Column:
    return F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2)))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))
