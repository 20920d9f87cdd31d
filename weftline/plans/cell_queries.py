"""Queries over a cell's whole telemetry: ``events`` of a user as a cell, purchases end turns, views start steps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import cells, rollup
from weftline.operators.checkpoints import checkpointed
from weftline.plans.registry import EV, event_segments, query, table


def _cell(spark, sf_dir):
    """(facts, lane): a step ends a minute before the next view or purchase; signups are the model's messages, clicks calls, errors results of the click before them; every
    event leaves a lane record as many minutes later as its ``k`` says."""
    props = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    ev = checkpointed(rollup.stepped(event_segments(spark, sf_dir)).join(props, "event_id").withColumnRenamed("session", "cell").withColumn("cents", F.round(F.col("value") * 100).cast("long")))
    order = W.partitionBy("cell").orderBy("ts", "event_id")
    ends = ev.where("event_type IN ('view', 'purchase')").withColumn("t1", F.lead("ts").over(order) - 60_000)
    steps = ends.where("event_type = 'view'").select("cell", "turn", "step", F.col("ts").alias("t0"), F.when(F.col("t1").isNotNull(), F.greatest("t1", "ts")).alias("t1"))
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    turns = ev.groupBy("cell", "turn").agg(F.min("ts").alias("t0"), F.max(bought).alias("t1"), F.max(bought).isNotNull().alias("completed"))
    said = ev.where("event_type = 'signup' AND step > 0").select("cell", "turn", "step", "ts", (F.col("cents") * 10).alias("hit"), F.col("cents").alias("miss"), (F.col("idx") % 50).alias("out"))
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    named = ev.withColumn("call_id", F.when(F.col("event_type") == "click", F.col("event_id")).otherwise(last))
    calls = named.where("event_type = 'click'").select("cell", "ts", "call_id")
    results = named.where("event_type = 'error' AND step > 0").select("cell", "turn", "step", "ts", "call_id")
    lane = ev.select("cell", (F.col("ts") + F.col("k") * 60_000).alias("ts"), F.col("k").alias("ms"), F.col("cents").alias("input"), (F.col("idx") % 3).alias("output"))
    return cells.facts(steps, turns, said, calls, results, lane), lane


def _catalogue() -> str:
    rows = [(scope, d.bucket, m, d.label, d.unit) for m, d in cells.METRICS.items() for scope in d.scopes] + [(scope, cells.METRICS[m].bucket, m, cells.METRICS[m].label, cells.METRICS[m].unit) for scope in cells.OUTSIDE for m in cells.LANE]
    return "cat(scope, bucket, metric, label, unit) AS (VALUES " + ", ".join(str(r) for r in rows) + ")"


CELL = f"""{EV}, o AS (SELECT ev.*, CAST(round(ev.value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(sum(CAST(ev.event_type = 'purchase' AS INT)) OVER (PARTITION BY session ORDER BY ev.ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM ev JOIN (SELECT event_id, props FROM events) USING (event_id)),
e AS (SELECT session AS cell, * EXCLUDE (session), sum(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY session, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called FROM o),
steps AS (SELECT cell, turn, step, ts AS t0, CASE WHEN nxt IS NOT NULL THEN greatest(nxt - 60000, ts) END AS t1 FROM (SELECT *, lead(ts) OVER (PARTITION BY cell ORDER BY ts, event_id) AS nxt FROM e WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'view'),
turns AS (SELECT cell, turn, min(ts) AS t0, max(CASE WHEN event_type = 'purchase' THEN ts END) AS t1 FROM e GROUP BY ALL), bounds AS (SELECT cell, min(t0) AS a, max(coalesce(t1, 4611686018427387904)) AS b FROM turns GROUP BY cell),
lane AS (SELECT cell, event_id, ts + k * 60000 AS ts, k AS ms, cents AS input, idx % 3 AS output FROM e),
put AS (SELECT lane.*, min(CASE WHEN s.turn IS NOT NULL THEN ROW(s.turn, s.step) END) AS s, min(t.turn) AS t FROM lane LEFT JOIN steps s ON s.cell = lane.cell AND lane.ts BETWEEN s.t0 AND coalesce(s.t1, 4611686018427387904) LEFT JOIN turns t ON t.cell = lane.cell AND lane.ts BETWEEN t.t0 AND coalesce(t.t1, 4611686018427387904) GROUP BY ALL),
loc AS (SELECT put.*, CASE WHEN s IS NOT NULL THEN 'step' WHEN t IS NOT NULL THEN 'gap' WHEN ts < a THEN 'pre' WHEN ts > b THEN 'tail' ELSE 'idle' END AS place, CASE WHEN s IS NOT NULL THEN s[1] ELSE t END AS turn, s[2] AS step FROM put JOIN bounds ON bounds.cell = put.cell),
fact AS (
  SELECT cell, 'step' AS place, turn, step, unnest([{{'m': 'steps', 'v': 1}}, {{'m': 'stepFrameMs', 'v': t1 - t0}}]) AS x FROM steps
  UNION ALL SELECT cell, 'turn', turn, NULL, unnest([{{'m': 'turns', 'v': 1}}, {{'m': 'turnFrameMs', 'v': t1 - t0}}, {{'m': 'turnsCompleted', 'v': CAST(t1 IS NOT NULL AS INT)}}]) FROM turns
  UNION ALL SELECT e.cell, 'step', e.turn, e.step, unnest([{{'m': 'llmCalls', 'v': 1}}, {{'m': 'llmMs', 'v': ts - t0}}, {{'m': 'hitTokens', 'v': cents * 10}}, {{'m': 'missTokens', 'v': cents}}, {{'m': 'outTokens', 'v': idx % 50}}]) FROM e JOIN steps s ON s.cell = e.cell AND s.turn = e.turn AND s.step = e.step WHERE event_type = 'signup'
  UNION ALL SELECT cell, 'step', turn, step, unnest([{{'m': 'toolCalls', 'v': 1}}, {{'m': 'toolMs', 'v': ts - called}}]) FROM e WHERE event_type = 'error' AND step > 0 AND called IS NOT NULL
  UNION ALL SELECT cell, place, turn, step, unnest([{{'m': 's1Calls', 'v': 1}}, {{'m': 's1Ms', 'v': ms}}, {{'m': 's1InputTokens', 'v': input}}, {{'m': 's1OutputTokens', 'v': output}}]) FROM loc),
sums AS (
  SELECT cell, 'cell' AS scope, NULL AS turn, NULL AS step, x.m AS metric, sum(x.v) AS value FROM fact GROUP BY cell, x.m
  UNION ALL SELECT cell, 'turn', turn, NULL, x.m, sum(x.v) FROM fact WHERE turn IS NOT NULL GROUP BY cell, turn, x.m UNION ALL SELECT cell, 'step', turn, step, x.m, sum(x.v) FROM fact WHERE place = 'step' GROUP BY cell, turn, step, x.m
  UNION ALL SELECT cell, place, CASE WHEN place = 'gap' THEN turn END, NULL, x.m, sum(x.v) FROM fact WHERE place IN ('gap', 'pre', 'idle', 'tail') GROUP BY 1, 2, 3, 5),
wide AS (SELECT cell, scope, turn, step, coalesce(sum(value) FILTER (metric = 'turnFrameMs'), 0) AS tf, coalesce(sum(value) FILTER (metric = 'stepFrameMs'), 0) AS sf FROM sums GROUP BY ALL),
{_catalogue()},
report AS (SELECT w.cell, w.scope, w.turn, w.step, bucket, c.metric, label, unit, CASE c.metric WHEN 'idleMs' THEN greatest(tf - sf, 0) WHEN 'completionMs' THEN tf ELSE coalesce(s.value, 0) END AS value
  FROM wide w JOIN cat c ON c.scope = w.scope LEFT JOIN sums s ON s.cell = w.cell AND s.scope = w.scope AND s.turn IS NOT DISTINCT FROM w.turn AND s.step IS NOT DISTINCT FROM w.step AND s.metric = c.metric)"""


@query(f"WITH {CELL} SELECT cell, scope, CAST(turn AS BIGINT) AS turn, CAST(step AS BIGINT) AS step, bucket, metric, label, unit, CAST(value AS BIGINT) AS value FROM report")
def cell_report(spark, sf_dir):
    """All metrics of all steps, turns and cells."""
    return cells.aggregate(_cell(spark, sf_dir)[0])


@query(f"WITH {CELL}, raw AS (SELECT cell, x.m AS metric, sum(x.v) AS raw FROM fact WHERE x.m LIKE 's1%' GROUP BY ALL) SELECT cell, metric, CAST(raw AS BIGINT) AS raw, CAST(raw AS BIGINT) AS places, CAST(0 AS BIGINT) AS difference FROM raw")
def cell_reconciled(spark, sf_dir):
    """Every lane record is in one place."""
    found, lane = _cell(spark, sf_dir)
    return cells.reconciled(cells.aggregate(found), lane)
