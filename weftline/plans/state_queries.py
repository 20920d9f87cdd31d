"""Queries over session state: ``conversations`` by turn, the first turns kept as a snapshot, the others added to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.checkpoints import checkpointed
from weftline.plans.registry import SEG, messages, query
from weftline.streaming import session_state


def _rows(spark, sf_dir):
    return messages(spark, sf_dir).select("session", F.sha2("text", 256).alias("id"), F.col("idx").alias("seq"), "tokens")


def _kept(spark, sf_dir):
    """What the first four segments of each session leave behind, with the second one settled."""
    early = checkpointed(session_state.placed(_rows(spark, sf_dir).where("seq < 4")))
    cursors = early.groupBy("session").agg(F.lit(2).alias("cursor"))
    return early, session_state.checked(session_state.snapshot(early, cursors))


FIRST = f"{SEG}, f AS (SELECT session, sha256(text) AS id, min(idx) AS first, arg_max(tokens, idx) AS tokens FROM seg GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first) - 1 AS idx FROM f)"


@query(f"WITH {FIRST} SELECT session, id, idx, least(idx, 16) AS offered FROM p")
def session_positions(spark, sf_dir):
    """Positions given before the snapshot and after it are those that one pass gives."""
    early, kept = _kept(spark, sf_dir)
    late = session_state.placed(_rows(spark, sf_dir).where("seq >= 4"), checkpointed(kept))
    return early.unionByName(late).where("fresh").select("session", "id", "idx", "offered")


@query(
    f"""WITH {FIRST.replace("FROM seg GROUP BY ALL", "FROM seg WHERE idx < 4 GROUP BY ALL")}
SELECT session, 2 AS version, string_agg(id, ',' ORDER BY idx) AS ids, CAST(sum(tokens) AS BIGINT) AS tokens, least(2, count(*)) AS cursor, CASE WHEN count(*) < 2 THEN 'cursor' ELSE '' END AS faults FROM p GROUP BY session"""
)
def session_snapshots(spark, sf_dir):
    """The snapshots themselves; a cursor beyond a session's end is put right and noted."""
    kept = _kept(spark, sf_dir)[1]
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda acc, s: acc + s["tokens"])
    return kept.select("session", "version", F.array_join("order", ",").alias("ids"), total.alias("tokens"), "cursor", F.array_join("faults", ",").alias("faults"))
