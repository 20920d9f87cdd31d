"""Telemetry roll-ups: facts in turns and steps, grouped sums with reconciliation, latencies, costs, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.costs import call_cost, hit_rate

#: Metrics of a scope: name, expression over the facts. Kept as whole cents, so that sums don't depend on their order.
METRICS = {
    "records": lambda: F.count("*"),
    "errors": lambda: F.count_if(F.col("event_type") == "error"),
    "cents": lambda: F.sum(F.round(F.col("value") * 100).cast("long")),
    "first_ts": lambda: F.min("ts"),
    "last_ts": lambda: F.max("ts"),
}


def stepped(events: DataFrame) -> DataFrame:
    """Events with ``turn`` (purchases before the event) and ``step`` (views in the turn up to it; 0: between steps)."""
    order = W.partitionBy("session").orderBy("ts", "event_id")
    inside = W.partitionBy("session", "turn").orderBy("ts", "event_id")
    turn = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    step = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("turn", turn.cast("long")).withColumn("step", step.cast("long"))


def scopes(facts: DataFrame) -> DataFrame:
    """(session, turn, step, scope, metrics): each step, turn and session in one pass; step 0 is a turn's gap."""
    sums = facts.groupingSets([["session"], ["session", "turn"], ["session", "turn", "step"]], "session", "turn", "step").agg(F.grouping_id("session", "turn", "step").alias("_g"), *[f().alias(n) for n, f in METRICS.items()])
    scope = F.when(F.col("_g") == 3, "cell").when(F.col("_g") == 1, "turn").when(F.col("step") == 0, "gap").otherwise("step")
    return sums.select("session", "turn", "step", scope.alias("scope"), *METRICS)


def long_format(rolled: DataFrame) -> DataFrame:
    """(session, scope, turn, step, metric, value): one row for each metric that is known."""
    keys = ["session", "scope", "turn", "step"]
    return rolled.select(*keys, *[F.col(c).cast("long").alias(c) for c in METRICS]).unpivot(keys, list(METRICS), "metric", "value").where("value IS NOT NULL")


def reconciled(rolled: DataFrame, facts: DataFrame) -> DataFrame:
    """(session, metric, raw, steps, difference): sums of the steps and gaps against a count of the raw records."""
    parts = rolled.where("scope IN ('step', 'gap')").groupBy("session").agg(*[F.sum(m).alias(m) for m in ("records", "errors", "cents")])
    raw = facts.groupBy("session").agg(*[METRICS[m]().alias(m) for m in ("records", "errors", "cents")])
    sides = [df.unpivot(["session"], ["records", "errors", "cents"], "metric", side) for df, side in ((raw, "raw"), (parts, "steps"))]
    return sides[0].join(sides[1], ["session", "metric"], "left").withColumn("difference", F.col("raw") - F.coalesce("steps", F.lit(0)))


def call_latency(events: DataFrame, call: str, result: str) -> DataFrame:
    """(session, call_id, result_id, ms): each result with the latest call before it that no other result took; orphans have no call.

    Calls and results pair like brackets of depth one: a result takes the call only if it is the first result since.
    """
    order = W.partitionBy("session").orderBy("ts", "event_id")
    rows = events.where(F.col("event_type").isin(call, result))
    before = rows.withColumn("_type", F.lag("event_type").over(order)).withColumn("_id", F.lag("event_id").over(order)).withColumn("_ts", F.lag("ts").over(order))
    took = F.col("_type") == call
    return before.where(F.col("event_type") == result).select("session", F.when(took, F.col("_id")).alias("call_id"), F.col("event_id").alias("result_id"), F.when(took, F.col("ts") - F.col("_ts")).alias("ms"))


def cost_summary(calls: DataFrame, prices: tuple[float, float, float], group: list[str]) -> DataFrame:
    """Tokens, hit rate and dollars of each group; calls have cached, uncached and output tokens."""
    sums = calls.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("cached", "uncached", "output")])
    return sums.withColumn("hit_rate", hit_rate(F.col("cached"), F.col("uncached"))).withColumn("usd", call_cost(F.col("cached"), F.col("uncached"), F.col("output"), prices))


def error_histogram(rows: DataFrame, group: str, message: Column) -> DataFrame:
    """(group, errors, kinds, top_error, top_count): messages cut at 120 characters; ties: the least message."""
    each = rows.groupBy(group, F.substring(message, 1, 120).alias("_m")).agg(F.count("*").alias("_n"))
    top = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_m").alias("m")))
    return each.groupBy(group).agg(F.sum("_n").alias("errors"), F.count("*").alias("kinds"), top.alias("_t")).select(group, "errors", "kinds", F.col("_t.m").alias("top_error"), (-F.col("_t.n")).alias("top_count"))


def conflict_free(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the one value that a group's rows agree on; null if they differ."""
    return rows.groupBy(group).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))
