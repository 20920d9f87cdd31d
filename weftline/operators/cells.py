"""A cell's telemetry in one long table: every metric of every step, turn and cell, with what falls between them, reconciled to the raw records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.timejoin import attribute


@dataclass(frozen=True)
class Metric:
    """``scopes``: where it is reported; ``bucket``: the table it belongs to."""

    label: str
    unit: str
    bucket: str
    scopes: tuple[str, ...] = ("cell", "turn", "step")


#: Names, units and scopes of the metrics: fixed values.
METRICS = {
    "turns": Metric("turns", "count", "time", ("cell",)),
    "steps": Metric("steps", "count", "time", ("cell", "turn")),
    "llmCalls": Metric("LLM calls", "count", "time"),
    "s1Calls": Metric("lane calls", "count", "time"),
    "toolCalls": Metric("other tool calls", "count", "time"),
    "llmMs": Metric("LLM time", "ms", "time"),
    "s1Ms": Metric("lane time", "ms", "time"),
    "toolMs": Metric("other tool time", "ms", "time"),
    "stepFrameMs": Metric("step frames", "ms", "time", ("cell", "turn")),
    "turnFrameMs": Metric("turn frames", "ms", "time", ("cell",)),
    "idleMs": Metric("between steps", "ms", "time", ("cell", "turn")),
    "hitTokens": Metric("cached input tokens", "token", "cost"),
    "missTokens": Metric("uncached input tokens", "token", "cost"),
    "outTokens": Metric("output tokens", "token", "cost"),
    "s1InputTokens": Metric("lane input tokens", "token", "cost"),
    "s1OutputTokens": Metric("lane output tokens", "token", "cost"),
    "turnsCompleted": Metric("turns completed", "count", "completion", ("cell",)),
    "completionMs": Metric("time to completion", "ms", "completion", ("cell",)),
}
#: What lane records count, and where they may fall outside steps.
LANE = ("s1Calls", "s1Ms", "s1InputTokens", "s1OutputTokens")
OUTSIDE = ("gap", "pre", "idle", "tail")


def _long(rows: DataFrame, place: Column | str, turn: Column | str, step: Column | str, values: dict[str, Column]) -> DataFrame:
    """(cell, place, turn, step, metric, value): one row for each value that is known."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value")) for m, v in values.items()]))
    out = rows.select("cell", F.lit(place).alias("place") if isinstance(place, str) else place.alias("place"), *[(F.col(c) if isinstance(c, str) else c).cast("long").alias(n) for c, n in ((turn, "turn"), (step, "step"))], cells.alias("_v"))
    return out.select("cell", "place", "turn", "step", "_v.*").where("value IS NOT NULL")


def placed(records: DataFrame, steps: DataFrame, turns: DataFrame) -> DataFrame:
    """Records (cell, ts, ...) with ``place``, ``turn`` and ``step``: in the step whose frame holds their time, else in that turn's gap, else before the first turn (pre), after the
    last (tail) or between two (idle). Frames are (cell, turn, step, t0, t1) and (cell, turn, t0, t1); an open end holds all that comes later."""
    inside = attribute(records, steps.select("cell", F.struct("turn", "step").alias("_step"), F.col("t0").alias("start"), F.col("t1").alias("end")), "cell", "_step").drop("scope")
    both = attribute(inside, turns.select("cell", F.col("turn").alias("_turn"), F.col("t0").alias("start"), F.col("t1").alias("end")), "cell", "_turn")
    at_step = F.col("_step").isNotNull()
    place = F.when(at_step, "step").when(F.col("_turn").isNotNull(), "gap").otherwise(F.col("scope"))
    return both.withColumn("place", place).withColumn("turn", F.when(at_step, F.col("_step.turn")).otherwise(F.col("_turn"))).withColumn("step", F.col("_step.step")).drop("_step", "_turn", "scope")


def facts(steps: DataFrame, turns: DataFrame, messages: DataFrame, calls: DataFrame, results: DataFrame, lane: DataFrame) -> DataFrame:
    """(cell, place, turn, step, metric, value), the one table that all sums are made of.

    ``messages`` (cell, turn, step, ts, hit, miss, out) last from their step's start; ``results`` (cell, turn, step, ts, call_id) from their call (cell, ts, call_id), of equal ids the
    last before them, and count only with one; ``lane`` (cell, ts, ms, input, output) goes by time.
    """
    frame = F.col("t1") - F.col("t0")
    said = messages.join(steps.select("cell", "turn", "step", "t0"), ["cell", "turn", "step"])
    both = calls.select("cell", "call_id", "ts", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("step"), F.lit(0).alias("_r")).unionByName(results.select("cell", "call_id", "ts", F.col("turn").cast("long"), F.col("step").cast("long"), F.lit(1).alias("_r")))
    began = F.last(F.when(F.col("_r") == 0, F.col("ts")), ignorenulls=True).over(W.partitionBy("cell", "call_id").orderBy("ts", "_r").rowsBetween(W.unboundedPreceding, 0))
    took = both.where("call_id IS NOT NULL").withColumn("_t0", began).where("_r = 1 AND _t0 IS NOT NULL")
    parts = [
        _long(steps, "step", "turn", "step", {"steps": F.lit(1), "stepFrameMs": frame}),
        _long(turns, "turn", "turn", F.lit(None), {"turns": F.lit(1), "turnFrameMs": frame, "turnsCompleted": F.col("completed").cast("long")}),
        _long(said, "step", "turn", "step", {"llmCalls": F.lit(1), "llmMs": F.col("ts") - F.col("t0"), "hitTokens": F.col("hit"), "missTokens": F.col("miss"), "outTokens": F.col("out")}),
        _long(took, "step", "turn", "step", {"toolCalls": F.lit(1), "toolMs": F.col("ts") - F.col("_t0")}),
        _long(placed(lane, steps, turns), F.col("place"), "turn", "step", {"s1Calls": F.lit(1), "s1Ms": F.col("ms"), "s1InputTokens": F.col("input"), "s1OutputTokens": F.col("output")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def aggregate(found: DataFrame) -> DataFrame:
    """(cell, scope, turn, step, bucket, metric, label, unit, value) of the facts: each step, turn and cell with all metrics of its scope, 0 where there is no fact, and the lane's
    share of each turn's ``gap`` and of what is before, between and after turns (``pre``, ``idle``, ``tail``).

    A turn is the sum of its steps and its gap; a cell is the sum of all, so that its lane totals are those of the raw records. A turn's ``idleMs`` is what of its frame
    no step covers, at least 0; a cell's ``completionMs`` is that of its turns.
    """
    outside = F.col("place").isin(*OUTSIDE)
    scopes = F.array_compact(
        F.array(
            F.struct(F.lit("cell").alias("scope"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("step")),
            F.when(F.col("turn").isNotNull(), F.struct(F.lit("turn").alias("scope"), F.col("turn"), F.lit(None).cast("long").alias("step"))),
            F.when(F.col("place") == "step", F.struct(F.lit("step").alias("scope"), F.col("turn"), F.col("step"))),
            F.when(outside, F.struct(F.col("place").alias("scope"), F.when(F.col("place") == "gap", F.col("turn")).alias("turn"), F.lit(None).cast("long").alias("step"))),
        )
    )
    sums = found.select("cell", F.explode(scopes).alias("_s"), "metric", "value").select("cell", "_s.*", "metric", "value").groupBy("cell", "scope", "turn", "step", "metric").agg(F.sum("value").alias("value"))
    keys = ["cell", "scope", "turn", "step"]
    rows = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    value = lambda name: F.coalesce(F.try_element_at("_m", F.lit(name)), F.lit(0).cast("long"))
    derived = {"idleMs": F.greatest(value("turnFrameMs") - value("stepFrameMs"), F.lit(0).cast("long")), "completionMs": value("turnFrameMs")}

    def of(scope: str) -> Column:
        names = LANE if scope in OUTSIDE else [m for m, d in METRICS.items() if scope in d.scopes]
        return F.array(*[F.struct(F.lit(METRICS[m].bucket).alias("bucket"), F.lit(m).alias("metric"), F.lit(METRICS[m].label).alias("label"), F.lit(METRICS[m].unit).alias("unit"), derived.get(m, value(m)).alias("value")) for m in names])

    table = of("cell")
    for scope in ("turn", "step", *OUTSIDE):
        table = F.when(F.col("scope") == scope, of(scope)).otherwise(table)
    return rows.select(*keys, F.explode(table).alias("_v")).select(*keys, "_v.*")


def reconciled(table: DataFrame, lane: DataFrame) -> DataFrame:
    """(cell, metric, raw, places, difference): lane metrics of the raw records against the sum over steps, gaps and what is outside turns."""
    values = {"s1Calls": F.lit(1), "s1Ms": F.col("ms"), "s1InputTokens": F.col("input"), "s1OutputTokens": F.col("output")}
    raw = _long(lane, "raw", F.lit(None), F.lit(None), values).groupBy("cell", "metric").agg(F.sum("value").alias("raw"))
    parts = table.where(F.col("scope").isin("step", *OUTSIDE) & F.col("metric").isin(*LANE)).groupBy("cell", "metric").agg(F.sum("value").alias("places"))
    return raw.join(parts, ["cell", "metric"], "left").withColumn("places", F.coalesce("places", F.lit(0))).withColumn("difference", F.col("raw") - F.col("places"))
