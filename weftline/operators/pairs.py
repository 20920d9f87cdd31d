"""Scored pairs of segments inside a sliding window, and what they say about coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.scorers import LEXICAL, TOPICS, Scorer

WINDOW = 16


def candidates(segments: DataFrame, keep: list[str], window: int = WINDOW, asked: DataFrame | None = None) -> DataFrame:
    """(session, from_idx, to_idx, a, b): each segment with the ``window`` before it; a and b hold the columns ``keep``. With ``asked``
    (session, to_idx, ...), only its segments, and its further columns.

    Segments are moved once, by session, and in order; each looks back over its window. Pairs are made where they stand and not moved, and what is
    ``asked`` is matched with segments, not with pairs.
    """
    own = segments.select("session", "idx", F.struct("idx", *keep).alias("b"))
    more = []
    if asked is not None:
        more = [c for c in asked.columns if c not in ("session", "to_idx")]
        own = own.join(asked.select("session", F.col("to_idx").alias("idx"), F.struct(F.lit(True).alias("_yes"), *more).alias("_asked")), ["session", "idx"], "left")
    back = W.partitionBy("session").orderBy("idx").rangeBetween(-window, -1)
    met = own.where("session IS NOT NULL").withColumn("_back", F.collect_list("b").over(back))
    if asked is not None:
        met = met.where("_asked IS NOT NULL")
    each = met.select("session", F.explode("_back").alias("a"), "b", *[F.col(f"_asked.{c}").alias(c) for c in more])
    return each.select("session", F.col("a.idx").alias("from_idx"), F.col("b.idx").alias("to_idx"), "a", "b", *more)


def scored(segments: DataFrame, scorer: Scorer, window: int = WINDOW) -> DataFrame:
    """(session, from_idx, to_idx, a, b, w, source): every pair of the window with the scorer's weight; features are made once for each segment."""
    return scorer.score(candidates(scorer.prepared(segments), scorer.names(segments), window)).withColumn("source", F.lit(scorer.source))


def lexical_scores(segments: DataFrame, window: int = WINDOW) -> DataFrame:
    """(session, from_idx, to_idx, w, source): overlap of token sets."""
    return scored(segments, LEXICAL, window).drop("a", "b")


def topic_scores(segments: DataFrame, window: int = WINDOW) -> DataFrame:
    """Scores of events by their topics; ``at`` is the newer segment's time."""
    return scored(segments, TOPICS, window).withColumn("at", F.col("b.ts")).drop("a", "b")


def edges(scores: DataFrame, threshold: float) -> DataFrame:
    """Finite scores of at least the threshold."""
    return scores.where(~F.isnan("w") & (F.col("w") >= threshold))


def offered(segments: DataFrame, windows: list[int]) -> DataFrame:
    """(session, w, segments, pairs): how many pairs each window offers, a closed form per row."""
    each = segments.select("session", "idx", F.explode(F.array(*[F.lit(w) for w in windows])).alias("w"))
    return each.groupBy("session", "w").agg(F.count("*").alias("segments"), F.sum(F.least("idx", "w")).alias("pairs"))


def pair_states(offered_pairs: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Every offered pair with its state: unsettled, rejected (below the threshold) or edge."""
    state = F.when(F.col("w").isNull(), "unsettled").when(F.col("w") >= threshold, "edge").otherwise("rejected")
    return offered_pairs.join(scores.select("session", "from_idx", "to_idx", "w"), ["session", "from_idx", "to_idx"], "left").withColumn("state", state)


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(session, idx, degree) of each endpoint."""
    ends = F.explode(F.array("from_idx", "to_idx")).alias("idx")
    return edge_rows.select("session", ends).groupBy("session", "idx").agg(F.count("*").alias("degree"))


def settled(scores: DataFrame) -> DataFrame:
    """(session, pairs, lane, lexical): distinct unordered pairs, each counted for the source of its first row by position; of a tie, the lane's."""
    pair = [F.least("from_idx", "to_idx").alias("a"), F.greatest("from_idx", "to_idx").alias("b")]
    at = lambda source: F.min(F.when(F.col("source") == source, F.col("pos")))
    first = scores.groupBy("session", *pair).agg(F.min("pos").alias("_pos"), at("s1-noul").alias("_lane"), at("lexical").alias("_lexical"))
    lane, lexical = (F.coalesce(F.col(c) == F.col("_pos"), F.lit(False)) for c in ("_lane", "_lexical"))
    return first.groupBy("session").agg(F.count("*").alias("pairs"), F.count_if(lane).alias("lane"), F.count_if(lexical & ~lane).alias("lexical"))


def first_refusal(segments: DataFrame, deferred: DataFrame, window: int = WINDOW) -> DataFrame:
    """(session, deferred, first_refused): the segment from which on the rows' pairs add up to the deferred ones; null if none does."""
    back = W.partitionBy("session").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)
    rows = segments.select("session", "idx", F.sum(F.least(F.col("idx"), F.lit(window))).over(back).alias("_left")).join(deferred, "session")
    return rows.groupBy("session", "deferred").agg(F.max(F.when((F.col("_left") == F.col("deferred")) & (F.col("deferred") > 0), F.col("idx"))).alias("first_refused"))


def unjudged(segments: DataFrame, scores: DataFrame, seeds: DataFrame, window: int = WINDOW) -> DataFrame:
    """(session, seed, idx): segments in the window before each seed without a score by the model, for the seed."""
    near = seeds.select("session", "seed", F.explode(F.sequence(F.greatest(F.col("seed") - window, F.lit(0)), F.col("seed"))).alias("idx")).where("idx < seed")
    judged = scores.where("source = 's1-noul'").select("session", F.col("to_idx").alias("seed"), F.col("from_idx").alias("idx"))
    return near.join(segments.select("session", "idx"), ["session", "idx"], "left_semi").join(judged, ["session", "seed", "idx"], "left_anti")


def saving_curve(segments: DataFrame, windows: list[int]) -> DataFrame:
    """(w, pairs, most, share): pairs over all sessions, the most for one segment, and the share of the full history's."""
    each = segments.select("idx", F.explode(F.array(*[F.lit(w) for w in windows])).alias("w"))
    return each.groupBy("w").agg(F.sum(F.least("idx", "w")).alias("pairs"), F.max(F.least("idx", "w")).alias("most"), F.try_divide(F.sum(F.least("idx", "w")), F.sum("idx")).alias("share"))
