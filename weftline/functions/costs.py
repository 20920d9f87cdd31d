"""Prices, cache arithmetic and normalised probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars per million tokens (cached, uncached, output), fixed values.
PRICES = {"base": (0.07, 0.27, 1.10), "large": (0.14, 0.55, 2.19), "small": (0.02, 0.10, 0.40)}


def decayed(weight: Column, age: Column, scale: float) -> Column:
    """weight * exp(-age / scale), no age below 0; the weight itself if scale is not positive."""
    return weight * F.exp(-F.greatest(F.lit(0.0), age.cast("double")) / scale) if scale > 0 else weight


def per_token_cost(hit_rate: Column, hit: Column, miss: Column) -> Column:
    """The mean price of an input token; the hit rate is kept within 0 and 1."""
    h = F.least(F.greatest(hit_rate, F.lit(0.0)), F.lit(1.0))
    return h * hit + (1 - h) * miss


def break_even_ratio(hit_rate: Column, hit: Column, miss: Column) -> Column:
    """How many tokens must go for each token whose cache entry is lost, at which a removal pays off after one step: the price of
    losing an entry over the mean price of a token; 0 where that is nothing."""
    cost = per_token_cost(hit_rate, hit, miss)
    return F.when(cost > 0, (miss - hit) / cost).otherwise(0.0)


def reselect(removed: Column, after: Column, steps: Column, hit_rate: Column, hit: Column, miss: Column) -> dict[str, Column]:
    """Whether removing tokens pays: steps * removed * price against the loss on the tokens after the cut."""
    h = F.least(F.greatest(hit_rate, F.lit(0.0)), F.lit(1.0))
    saving = steps * removed * per_token_cost(hit_rate, hit, miss)
    loss = after * h * (miss - hit)
    lost = h * after
    return {"saving": saving, "loss": loss, "adopt": saving > loss, "ratio": F.when(lost > 0, removed / lost).otherwise(F.lit(float("inf")))}


def aligned(tokens: Column, block: int = 64) -> Column:
    """Rounded down to whole cache blocks."""
    return (F.floor(tokens / block) * block).cast("long")


def call_cost(cached: Column, uncached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    return (cached * prices[0] + uncached * prices[1] + output * prices[2]) / 1_000_000


def hit_rate(cached: Column, uncached: Column) -> Column:
    """cached / (cached + uncached); 0 if there are none."""
    return F.coalesce(F.try_divide(cached, cached + uncached), F.lit(0.0))
