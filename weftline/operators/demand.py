"""Scoring as it is needed: by a sweep over unsettled rows under a pair budget, or level by level of a walk that asks for its own rows.

A row is a segment with its window: the pairs from the window's segments to it. Scores are rows (session, from_idx, to_idx, w, source, at).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.costs import decayed
from weftline.operators.checkpoints import checkpointed
from weftline.operators.pairs import WINDOW, candidates
from weftline.operators.recall import expanded, started, weighed
from weftline.operators.scorers import LEXICAL, MODEL, Scorer, valid

ROW = ["session", "to_idx"]
PAIR = ["session", "from_idx", "to_idx"]


def _sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Swept:
    """What a sweep did: the scores it paid for, and (session, scored_pairs, judged_pairs, edges, deferred_pairs, deferred_segments)."""

    scores: DataFrame
    sessions: DataFrame


def sweep(
    segments: DataFrame, scorer: Scorer, threshold: float, window: int = WINDOW, max_pairs: int | None = None, settled: DataFrame | None = None, anchors: DataFrame | None = None, fallback: Scorer = LEXICAL
) -> Swept:
    """Scores the rows of each session that are not ``settled`` (session, idx), oldest first, after the row of its anchor (session, idx).

    A row that would take the session's pairs beyond ``max_pairs`` ends its sweep, unless it is the first; so does a row that the
    scorer refuses. What comes at or after that row by position and was not offered is deferred whole: to be offered again. A row
    that the scorer leaves without an answer, wholly or in part, is scored by ``fallback`` and counts as scored, not as judged, as does all that
    a local scorer says. Segments
    without a window have nothing to score. Edges are pairs of at least the threshold.
    """
    rows = segments.select("session", "idx", "ts", F.least(F.col("idx"), F.lit(window)).alias("_pairs")).where("_pairs > 0")
    if settled is not None:
        rows = rows.join(settled.select("session", "idx").distinct(), ["session", "idx"], "left_anti")
    first = F.lit(1)
    if anchors is not None:
        rows = rows.join(anchors.select("session", "idx").distinct().withColumn("_anchor", F.lit(True)), ["session", "idx"], "left")
        first = F.when(F.col("_anchor"), 0).otherwise(1)
    every = W.partitionBy("session")
    order = every.orderBy("_first", "idx")
    rows = rows.withColumn("_first", first).withColumn("_place", F.row_number().over(order))
    before = F.coalesce(F.sum("_pairs").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = (before > 0) & (before + F.col("_pairs") > max_pairs) if max_pairs is not None else F.lit(False)
    rows = rows.withColumn("_over", over).withColumn("_stop", F.min(F.when(F.col("_over"), F.col("_place"))).over(every))
    rows = checkpointed(rows.select("session", "idx", "ts", "_pairs", "_place", "_stop"))

    affordable = rows.where("_stop IS NULL OR _place < _stop").select("session", F.col("idx").alias("to_idx"), "ts", "_pairs", "_place")
    answers = scorer.score(candidates(scorer.prepared(segments), scorer.names(segments), window, affordable)).drop("a", "b")
    if "refused" not in answers.columns:
        answers = answers.withColumn("refused", F.lit(False))
    # a row has its pairs in a list, so that what is told of it goes with them; a refusal ends the rows from its place on
    told = answers.groupBy(*ROW, "ts", "_place", "_pairs").agg(F.max(F.coalesce("refused", F.lit(False))).alias("_refused"), F.min(valid(F.col("w"))).alias("_answered"), F.collect_list(F.struct("from_idx", "w")).alias("_scores"))
    told = checkpointed(told.withColumn("_end", F.min(F.when(F.col("_refused"), F.col("_place"))).over(every)))
    ends = told.where("_end IS NOT NULL").groupBy("session").agg(F.min("_end").alias("_end"))
    offered = told.where("_end IS NULL OR _place < _end")

    by_model = offered.where("_answered").select(*ROW, F.explode("_scores").alias("_s"), "ts").select(*ROW, "_s.from_idx", "_s.w", "ts").select(*PAIR, "w", F.lit(scorer.source).alias("source"), F.col("ts").alias("at"))
    unanswered = candidates(fallback.prepared(segments), fallback.names(segments), window, offered.where("NOT _answered").select(*ROW, "ts"))
    local = checkpointed(fallback.score(unanswered).where(~F.isnan("w")).select(*PAIR, "w", F.lit(fallback.source).alias("source"), F.col("ts").alias("at")))
    scores = by_model.unionByName(local)

    stop = rows.join(ends, "session", "left").where(F.col("_place") == F.least("_stop", "_end")).select("session", F.col("idx").alias("_from"))
    left = rows.join(stop, "session").where(F.col("idx") >= F.col("_from")).join(offered.select("session", F.col("to_idx").alias("idx")), ["session", "idx"], "left_anti")
    deferred = left.groupBy("session").agg(_sum("_pairs").alias("deferred_pairs"), F.count("*").alias("deferred_segments"))
    judged = F.when(F.col("_answered") & F.lit(scorer.source == MODEL), F.col("_pairs"))
    done = offered.groupBy("session").agg(_sum("_pairs").alias("scored_pairs"), _sum(judged).alias("judged_pairs"))
    edges = scores.where(F.col("w") >= threshold).groupBy("session").agg(F.count("*").alias("edges"))
    whole = segments.select("session").distinct().join(done, "session", "left").join(edges, "session", "left").join(deferred, "session", "left")
    return Swept(scores, whole.select("session", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("scored_pairs", "judged_pairs", "edges", "deferred_pairs", "deferred_segments")]))


@dataclass(frozen=True)
class Demanded:
    """What a walk found and asked for.

    ``hits`` as ``recall`` returns them; ``levels`` (session, depth, rows, pairs, judged, missed, missed_pairs, skipped) for levels that needed
    rows; ``sessions`` (session, stop) with the sums over levels; ``scores``: the new ones.
    """

    hits: DataFrame
    levels: DataFrame
    sessions: DataFrame
    scores: DataFrame


def recall_demand(
    segments: DataFrame, seeds: DataFrame, scored: DataFrame, scorer: Scorer, threshold: float, depth: int, window: int = WINDOW, scale: float = 0.0, max_pairs: int | None = None, held: DataFrame | None = None
) -> Demanded:
    """The walk of ``recall`` from ``seeds`` (session, seed, now), which scores the rows that it stands on before it goes on from them.

    A level needs the pairs of its segments' windows that have no score in ``scored``; where the scorer is a model, a local score is none
    either. Rows that are ``held`` (session, idx) by another caller are skipped. Rows come back answered, with every weight valid, or
    missed, of which nothing is kept: the walk reads what is there. A row's score stands in place of an older one of the pair. A
    session that has paid for ``max_pairs`` pairs or more asks for no further level and ends there (``budget``); one whose last level is at
    ``depth`` ends with ``depth``, others when nothing new is found (``complete``).

    Segments and known scores are written once, the scores as one list for each row. A level takes its rows' lists out of these and looks back
    over the segments; what it asked for and what it found is checkpointed, and no pairs are moved but the level's own.
    """
    segments = checkpointed(segments)
    known = checkpointed(scored.groupBy(*ROW).agg(F.collect_list(F.struct("from_idx", "w", "source", "at")).alias("_known")))
    reached = checkpointed(started(seeds))
    level, now = reached, seeds.select("session", "now")
    positions = segments.select("session", "idx", "ts")
    age = F.col("now") - F.col("at") if scale > 0 else F.lit(0)
    arcs_so_far: list[DataFrame] = []
    counted: list[DataFrame] = []
    bought: list[DataFrame] = []
    stops: list[DataFrame] = []
    for k in range(depth):
        if max_pairs is not None and counted:
            spent = _all(counted).groupBy("session").agg(F.sum("pairs").alias("_spent")).where(F.col("_spent") >= max_pairs).select("session")
            stops.append(checkpointed(level.select("session").distinct().join(spent, "session", "left_semi").withColumn("stop", F.lit("budget"))))
            level = level.join(spent, "session", "left_anti")
        rows = level.where("idx > 0").join(positions, ["session", "idx"]).select("session", F.col("idx").alias("to_idx"), "ts")
        flag = F.lit(None).cast("boolean")
        rows = rows.join(known, ROW, "left")
        if held is not None:
            rows = rows.join(held.select("session", F.col("idx").alias("to_idx")).distinct().withColumn("_held", F.lit(True)), ROW, "left")
        else:
            rows = rows.withColumn("_held", flag)
        rows = checkpointed(rows)
        enough = F.filter("_known", lambda s: s["source"] == MODEL) if scorer.source == MODEL else F.col("_known")
        enough = F.coalesce(F.transform(enough, lambda s: s["from_idx"]), F.array().cast("array<bigint>"))
        missing = candidates(scorer.prepared(segments), scorer.names(segments), window, rows.select(*ROW, "ts", "_held", enough.alias("_enough"))).where(~F.array_contains("_enough", F.col("from_idx")))
        answers = scorer.score(missing.where("_held IS NULL").drop("_held", "_enough")).drop("a", "b")
        answers = answers.select(*PAIR, "ts", "w", F.min(valid(F.col("w"))).over(W.partitionBy(*ROW)).alias("_answered"))
        if held is not None:
            answers = answers.unionByName(missing.where("_held").select(*PAIR, "ts", F.lit(None).cast("double").alias("w"), flag.alias("_answered")))
        answers = checkpointed(answers)
        per_row = answers.groupBy(*ROW).agg(F.count("*").alias("_n"), F.max("_answered").alias("_answered"))
        judged = F.when(F.col("_answered") & F.lit(scorer.source == MODEL), F.col("_n"))
        asked, missed = F.col("_answered").isNotNull(), F.when(~F.col("_answered"), F.col("_n"))
        level_counts = per_row.groupBy("session").agg(
            F.count_if(asked).alias("rows"), _sum(F.when(asked, F.col("_n"))).alias("pairs"), _sum(judged).alias("judged"), F.count(missed).alias("missed"), _sum(missed).alias("missed_pairs"), F.count_if(~asked).alias("skipped")
        ).select("session", F.lit(k).alias("depth"), "rows", "pairs", "judged", "missed", "missed_pairs", "skipped")
        counted.append(level_counts if max_pairs is None else checkpointed(level_counts))
        new = answers.where("_answered").select(*PAIR, "w", F.lit(scorer.source).alias("source"), F.col("ts").alias("at"))
        bought.append(new)
        # the level's rows: new scores, and older ones of pairs that have no new one
        own = rows.select(*ROW, F.inline("_known")).select(*PAIR, "w", "source", "at").join(new.select(*PAIR), PAIR, "left_anti").unionByName(new)
        reach = own.join(now, "session").withColumn("e", decayed(F.col("w"), age, scale)).where(~F.isnan("e") & (F.col("e") > threshold) & (F.col("from_idx") < F.col("to_idx")))
        arcs = checkpointed(reach.select("session", "to_idx", "from_idx", "e"))
        arcs_so_far.append(arcs)
        level = checkpointed(expanded(level, arcs, reached, k + 1))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    else:
        stops.append(level.select("session").distinct().withColumn("stop", F.lit("depth")))
    hits = weighed(reached, _all(arcs_so_far), depth) if arcs_so_far else reached.where("depth > 0").withColumn("w", F.lit(None).cast("double"))
    levels = _all(counted)
    sums = levels.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("rows", "pairs", "judged", "missed", "missed_pairs", "skipped")])
    ended = seeds.select("session").distinct()
    stop = _all(stops).groupBy("session").agg(F.min("stop").alias("stop")) if stops else ended.limit(0).withColumn("stop", F.lit(""))
    done = ended.join(sums, "session", "left").join(stop, "session", "left")
    sessions = done.select("session", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "pairs", "judged", "missed", "missed_pairs", "skipped")], F.coalesce("stop", F.lit("complete")).alias("stop"))
    return Demanded(hits, levels, sessions, _all(bought))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
