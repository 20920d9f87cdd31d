"""How well one set of rows predicts another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_quality(predicted: DataFrame, truth: DataFrame, key: str, group: str) -> DataFrame:
    """(group, tp, fp, fn, precision, recall, f1) of two sets of (group, key); repeated rows count once.

    Precision is 0 where nothing is predicted and f1 where both shares are 0; recall and f1 are null where the truth is empty.
    """
    marked = predicted.select(group, key, F.lit(1).alias("_p"), F.lit(0).alias("_t")).union(truth.select(group, key, F.lit(0), F.lit(1)))
    once = marked.groupBy(group, key).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    counts = once.groupBy(group).agg(*[F.count_if((F.col("_p") == p) & (F.col("_t") == t)).alias(name) for name, p, t in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    shares = counts.withColumn("precision", F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))).withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)))
    p, r = F.col("precision"), F.col("recall")
    return shares.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
