"""Recall: bounded breadth-first walk from newer to older segments over decayed scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.costs import decayed
from weftline.operators.checkpoints import checkpointed


def walkable(scores: DataFrame, seeds: DataFrame, threshold: float, scale: float = 0.0) -> DataFrame:
    """(session, to_idx, from_idx, e): backward scores whose decayed weight exceeds the threshold.

    ``seeds`` has one row (session, seed, now) for each walk; ages run from the scores' ``at`` to ``now``.
    """
    rows = scores.join(seeds.select("session", "now"), "session") if scale > 0 else scores.join(seeds.select("session"), "session", "left_semi")
    age = F.col("now") - F.col("at") if scale > 0 else F.lit(0)
    rows = rows.withColumn("e", decayed(F.col("w"), age, scale))
    return rows.where(~F.isnan("e") & (F.col("e") > threshold) & (F.col("from_idx") < F.col("to_idx"))).select("session", "to_idx", "from_idx", "e")


def recall(seeds: DataFrame, arcs: DataFrame, depth: int) -> DataFrame:
    """(session, idx, depth, via, w, pos) of each hit.

    Level by level: the heads of arcs out of the last level that were not reached before. ``via`` is the parent that found a
    hit: the earliest in order of discovery, children of a parent by weight (heaviest first, then newest). ``w`` is the heaviest
    arc into the hit from any expanded segment, not the product along a path. Seeds are no hits.
    """
    arcs = checkpointed(arcs)
    reached = checkpointed(started(seeds))
    level = reached
    for k in range(1, depth + 1):
        level = checkpointed(expanded(level, arcs, reached, k))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return weighed(reached, arcs, depth)


def started(seeds: DataFrame) -> DataFrame:
    """Level 0 of a walk: (session, idx, depth, via, pos) of the seeds."""
    return seeds.select("session", F.col("seed").alias("idx"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via"), F.lit(1).alias("pos"))


def expanded(level: DataFrame, arcs: DataFrame, reached: DataFrame, k: int) -> DataFrame:
    """Level ``k``: what the arcs out of the level before it lead to, and was not reached before."""
    order = W.partitionBy("session").orderBy("_p", F.desc("_e"), F.desc("idx"))
    out = level.select("session", F.col("idx").alias("to_idx"), F.col("pos").alias("_p")).join(arcs, ["session", "to_idx"])
    new = out.join(reached.select("session", F.col("idx").alias("from_idx")), ["session", "from_idx"], "left_anti")
    found = new.groupBy("session", F.col("from_idx").alias("idx")).agg(F.min(F.struct("_p", (-F.col("e")).alias("_e"), "to_idx")).alias("_best"))
    ranked = found.select("session", "idx", F.lit(k).alias("depth"), F.col("_best.to_idx").alias("via"), F.col("_best._p").alias("_p"), (-F.col("_best._e")).alias("_e"))
    return ranked.withColumn("pos", F.row_number().over(order)).drop("_p", "_e")


def weighed(reached: DataFrame, arcs: DataFrame, depth: int) -> DataFrame:
    """The hits of a walk with the heaviest arc into each, from segments that were expanded."""
    opened = reached.where(F.col("depth") < depth).select("session", F.col("idx").alias("to_idx"))
    weights = arcs.join(opened, ["session", "to_idx"]).groupBy("session", F.col("from_idx").alias("idx")).agg(F.max("e").alias("w"))
    return reached.where("depth > 0").join(weights, ["session", "idx"])


def forward_audit(tree: DataFrame) -> DataFrame:
    """(session, forward, backward): tree arcs by direction; a sound recall has no forward ones."""
    return tree.groupBy("session").agg(F.count_if(F.col("idx") >= F.col("via")).alias("forward"), F.count_if(F.col("idx") < F.col("via")).alias("backward"))


def ordered(hits: DataFrame, by_weight: bool = True) -> Column:
    """A hit's place in its session: by weight and then discovery, or by age."""
    keys = [F.desc("w"), "depth", "pos"] if by_weight else ["idx"]
    return F.row_number().over(W.partitionBy("session").orderBy(*keys))
