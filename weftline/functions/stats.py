"""Exact and asymptotic tests, quantiles and the counter-based generator as column expressions."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, eight steps up, where it is exact to 14 digits."""
    z = n.cast("double") + 9
    up = F.lit(0.0)
    for i in range(1, 9):
        up = up + F.log(n + i)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - up


def mcnemar_exact(b: Column, c: Column) -> Column:
    """min(1, P(X <= min(b, c))) for X binomial over b + c with one half; 1 without discordant pairs. Blind to direction.

    The sum goes from its last and largest term down. Terms fall at least as fast as a normal density of deviation sqrt(b + c) / 2, so that
    those more than 10 sqrt(b + c) + 50 places down add nothing to a double, however many pairs there are.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    last = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * 0.6931471805599453)
    places = F.least(k, F.floor(10 * F.sqrt(n.cast("double"))) + 50)
    steps = F.when(places > 0, F.sequence(F.lit(1).cast("long"), places.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), last * F.aggregate(steps, one, add)["sum"]))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation of erfc (error below 1.2e-7), symmetric about 0."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # coefficients of the approximation, fixed values, from the highest power
    poly = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(a) + t * poly
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def mcnemar_asymptotic(b: Column, c: Column) -> Column:
    """Two-sided p of the continuity-corrected statistic (|b - c| - 1)^2 / (b + c), the numerator's root no less than 0."""
    root = F.greatest(F.abs(b - c) - 1, F.lit(0)) / F.sqrt((b + c).cast("double"))
    return F.when(b + c == 0, 1.0).otherwise(2 * normal_cdf(-root))


def margin_statistic(b: Column, c: Column, margin: float) -> Column:
    """z of the shifted sign test, (difference + margin) * sqrt(b + c), with the difference among discordant pairs; null without any."""
    return F.when(b + c > 0, ((b - c) / (b + c) + margin) * F.sqrt((b + c).cast("double")))


def shifted_margin(b: Column, c: Column, margin: float, absolute: bool = False) -> Column:
    """One-sided p against a margin: Phi(-z); 1 without discordant pairs. ``absolute`` takes |z|."""
    z = margin_statistic(b, c, margin)
    return F.when(b + c == 0, 1.0).otherwise(normal_cdf(-(F.abs(z) if absolute else z)))


def detectable(pairs: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The least difference that so many discordant pairs show (two-sided alpha): (z of 1 - alpha / 2 + z of power) / sqrt(pairs).

    Null without pairs; above 1 nothing can be told apart. ValueError unless alpha is in (0, 1) and power in (0.5, 1).
    """
    if not (0 < alpha < 1 and 0.5 < power < 1):
        raise ValueError("alpha must be in (0, 1) and power in (0.5, 1)")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(pairs > 0, z / F.sqrt(pairs.cast("double")))


def asymptotic_fits(b: Column, c: Column) -> Column:
    return (b + c >= 25) & (F.least(b, c) >= 5)


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without overflowing a long."""
    low, high = a.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(a, 16)
    return (low * b + (high * b).bitwiseAND(F.lit(65535)) * 65536).bitwiseAND(F.lit(4294967295))


def draw(k: Column, seed: int) -> Column:
    """The k-th (from 1) uniform draw in [0, 1) of a counter-based 32-bit generator: a function of k alone."""
    mask = F.lit(4294967295)
    # increment and multipliers of the generator, fixed values
    a = (F.lit(seed).cast("long") + times32(k.cast("long").bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(mask)
    t = times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    u = (t + times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask)
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296


def draws(first: int, count: int, seed: int) -> np.ndarray:
    """The draws of number ``first`` and those after it, as ``draw`` makes them."""
    low = np.uint64(0xFFFFFFFF)
    a = (np.uint64(seed) + (np.arange(first, first + count, dtype=np.uint64) & low) * np.uint64(0x6D2B79F5)) & low
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & low
    t ^= (t + (t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & low
    return (t ^ (t >> np.uint64(14))) / 4294967296


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, names of ranks): the values at ranks (from 0, expressions over the group's size ``n``) of each group in order.

    Rows are counted by value first, so that a running sum over the different values gives the ranks: no group is gathered.
    """
    order = W.partitionBy(group).orderBy(value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("n", F.sum("_c").over(W.partitionBy(group)))
    return upto.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name) for name, at in ranks.items()])
