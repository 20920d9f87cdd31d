"""Queries over recall trees as nested JSON, and over calls matched one to one with steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import timejoin, trees
from weftline.plans.catalog import recall_tree
from weftline.plans.registry import DEPTH, EV, TOPIC, WALK, event_segments, query


def _nodes(spark, sf_dir):
    """The walk's hits, with the seeds as roots."""
    hits = recall_tree(spark, sf_dir).select("session", "idx", "via", "depth")
    seeds = event_segments(spark, sf_dir).groupBy("session").agg(F.max("idx").alias("idx"))
    return hits.unionByName(seeds.select("session", "idx", F.lit(None).cast("long").alias("via"), F.lit(0).alias("depth")))


def _nested_sql() -> str:
    out = f"n{DEPTH + 1} AS (SELECT CAST(NULL AS BIGINT) AS session, CAST(NULL AS BIGINT) AS via, CAST(NULL AS BIGINT) AS idx, '' AS t WHERE false)"
    for k in range(DEPTH, -1, -1):
        out += f""",
n{k} AS (SELECT r.session, r.via, r.idx, '"' || r.idx || '":{{' || coalesce(c.t, '') || '}}' AS t FROM r{k} r LEFT JOIN (SELECT session, via, string_agg(t, ',' ORDER BY idx) AS t FROM n{k + 1} GROUP BY ALL) c ON c.session = r.session AND c.via = r.idx)"""
    return out


@query(f"WITH {EV}, {TOPIC}, {WALK}, {_nested_sql()} SELECT session, '{{' || t || '}}' AS tree FROM n0")
def nested_tree(spark, sf_dir):
    """Each session's recall as one nested object."""
    return trees.nested(_nodes(spark, sf_dir), DEPTH)


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT session, CAST(idx AS VARCHAR) AS id, CAST(via AS VARCHAR) AS via, depth, CAST(NULL AS VARCHAR) AS fault FROM u{DEPTH}")
def flat_tree(spark, sf_dir):
    """The nested objects read back: the round trip gives the walk."""
    return trees.flattened(nested_tree(spark, sf_dir), DEPTH)


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT session, depth, count(*) AS nodes FROM hits GROUP BY ALL")
def tree_layers(spark, sf_dir):
    return trees.layers(trees.flattened(nested_tree(spark, sf_dir), DEPTH))


@query(
    f"""WITH RECURSIVE {EV}, v AS (SELECT session, ts, event_id AS id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS n FROM ev WHERE event_type = 'view'),
c AS (SELECT session, ts, event_id AS id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS k, (SELECT count(*) FROM v WHERE v.session = ev.session AND v.ts < ev.ts) AS f FROM ev WHERE event_type IN ('click', 'error')),
walk AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS right_id, CAST(NULL AS BIGINT) AS right_ts FROM (SELECT DISTINCT session FROM c)
  UNION ALL SELECT c.session, c.k, CASE WHEN v.ts - c.ts <= 86400000 THEN v.n ELSE used END, c.id, c.ts, CASE WHEN v.ts - c.ts <= 86400000 THEN v.id END, CASE WHEN v.ts - c.ts <= 86400000 THEN v.ts END
  FROM walk JOIN c ON c.session = walk.session AND c.k = walk.k + 1 LEFT JOIN v ON v.session = c.session AND v.n = greatest(c.f, used + 1))
SELECT session, id, ts, right_id, right_ts FROM walk WHERE k > 0"""
)
def steps_one_to_one(spark, sf_dir):
    """Clicks and errors with the first view at or after them that no earlier one took, within a day."""
    ev = event_segments(spark, sf_dir).select("session", "ts", F.col("event_id").alias("id"), "event_type")
    return timejoin.one_to_one(ev.where("event_type IN ('click', 'error')"), ev.where("event_type = 'view'"), "session", 86_400_000)
