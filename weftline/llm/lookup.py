"""Joins with a table of one row for each key, where a few keys may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one row in so many is hot; there are at most as many hot keys.
HOT = 1000


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``found``, which has one row for each value of ``keys`` (none of them null) and its share of ``total`` in ``weight``.

    Hot keys, of which there are at most ``HOT``, whatever the input, are broadcast; their rows go on spread over all tasks, and only
    the others meet their key in a shuffle. ``weight`` is left out of the result.
    """
    extra = [c for c in found.columns if c not in (*keys, weight)]
    hot = found.where(F.col(weight) * HOT >= total).select(*keys, F.struct(*extra).alias("_hot"))
    cold = found.where(F.col(weight) * HOT < total).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*extra).alias("_cold"))
    told = rows.join(F.broadcast(hot), keys, "left")
    spread = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))).otherwise(0)
    both = told.withColumn("_salt", spread.cast("long")).join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in extra])
