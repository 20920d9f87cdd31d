"""Paired comparisons of two arms: pairing, discordance, Holm adjustment, bootstrap intervals, verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.stats import asymptotic_fits, draws, mcnemar_asymptotic, mcnemar_exact

#: Positions of a block and resamples of a range that one task works on, and draws it makes at a time.
BLOCK, RANGE, STEP = 1_000_000, 250, 2_000_000


def paired(results: DataFrame, arms: int) -> DataFrame:
    """Rows (key, arm, ...) of the keys that every arm has."""
    whole = results.groupBy("key").agg(F.count_distinct("arm").alias("_n")).where(F.col("_n") == arms)
    return results.join(whole.select("key"), "key", "left_semi")


def discordance(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, b, c): pairs (x, y) of 0 and 1; b counts 1/0, c counts 0/1."""
    return pairs.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.expr("x = 1 AND y = 0")).alias("b"), F.count_if(F.expr("x = 0 AND y = 1")).alias("c"))


def tested(counts: DataFrame) -> DataFrame:
    """With p_one (exact), p_two, p_asymptotic, the asymptotic rule, and the sign of b - c."""
    b, c = F.col("b"), F.col("c")
    one = mcnemar_exact(b, c)
    return counts.withColumn("p_one", one).withColumn("p_two", F.least(F.lit(1.0), 2 * one)).withColumn("p_asymptotic", mcnemar_asymptotic(b, c)).withColumn("asymptotic_fits", asymptotic_fits(b, c)).withColumn("sign", F.signum((b - c).cast("double")))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """With ``adjusted`` and ``reject``, over the few rows of one family; ties by ``name``."""
    family = W.partitionBy()
    order = W.partitionBy().orderBy(p, "name")
    step = tests.withColumn("_k", F.count("*").over(family)).withColumn("_i", F.row_number().over(order))
    adjusted = F.max(F.least(F.lit(1.0), (F.col("_k") - F.col("_i") + 1) * F.col(p))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return step.withColumn("adjusted", adjusted).drop("_k", "_i").withColumn("reject", F.col("adjusted") <= alpha)


def resampled(rows: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """(by..., resample, total, n): sums of n differences (by..., pos from 0, n, d) drawn with replacement.

    Draws are functions of their number, so that every series of the same n sees the same draws. A task has a block of positions and a range of resamples, makes
    the range's draws anew and sums those that fall into its block: differences are moved once for each range, draws never.
    """

    def sums(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        n, block, part = (int(first.column(c)[0].as_py()) for c in ("n", "_block", "_range"))
        d = np.zeros(BLOCK)
        pos = table.column("pos").to_numpy() - block * BLOCK
        d[pos] = table.column("d").to_numpy().astype(np.float64)
        ids = np.arange(part * RANGE, min((part + 1) * RANGE, resamples))
        totals = np.zeros(len(ids))
        for i, r in enumerate(ids.tolist()):
            for a in range(0, n, STEP):
                at = np.floor(draws(r * n + a + 1, min(STEP, n - a), seed) * n).astype(np.int64) - block * BLOCK
                totals[i] += d[at[(at >= 0) & (at < BLOCK)]].sum()
        keys = [pa.chunked_array([first.column(c).combine_chunks().take(pa.array(np.zeros(len(ids), np.int64)))]) for c in by]
        return pa.table([*keys, pa.array(ids), pa.array(totals), pa.array(np.full(len(ids), n))], names=[*by, "resample", "total", "n"])

    kinds = dict(rows.dtypes)
    ranges = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // RANGE)))
    parts = rows.select(*by, F.col("pos").cast("long"), F.col("n").cast("long"), F.col("d").cast("double"), F.floor(F.col("pos") / BLOCK).alias("_block"), ranges.alias("_range"))
    done = parts.groupBy(*by, "_block", "_range").applyInArrow(sums, ", ".join(f"{c} {kinds[c]}" for c in by) + ", resample long, total double, n long")
    return done.groupBy(*by, "resample").agg(F.sum("total").alias("total"), F.max("n").alias("n"))


def bootstrap_sums(differences: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(resample, total, n): the sum of n differences (pos from 0, d) drawn with replacement, for each resample."""
    rows = differences.withColumn("n", F.lit(differences.count())).withColumn("series", F.lit(0))
    return resampled(rows, ["series"], resamples, seed).drop("series")


def interval(sums: DataFrame) -> DataFrame:
    """(low, high, p_one, p_two) of the resampled means: type-7 quantiles at 2.5 and 97.5 per cent."""
    mean = F.col("total") / F.col("n")
    below, above, n = F.count_if(mean <= 0), F.count_if(mean >= 0), F.count("*")
    return sums.agg(F.percentile(mean, F.lit(0.025)).alias("low"), F.percentile(mean, F.lit(0.975)).alias("high"), (below / n).alias("p_one"), F.least(F.lit(1.0), 2 * F.least(below, above) / n).alias("p_two"))
