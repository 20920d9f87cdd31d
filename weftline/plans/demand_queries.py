"""Queries over scoring on demand and in sweeps: ``events`` as sessions with a rule over topics for a model, ``conversations`` with overlaps.

The model leaves rows without an answer, other callers hold some, and some were scored before, all told by the rows' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import demand, pairs
from weftline.operators.scorers import LEXICAL, LOCAL, MODEL, TOPICS, Scorer, topic_weight
from weftline.plans.registry import DEPTH, EV, LEX, LOW, SEG, TOPIC, event_segments, messages, query, rounded

#: Decay of 30 days in milliseconds, the threshold of these walks, and what a walk or a sweep may pay for in a session.
SLOW, STEEP, WALK_PAIRS, SWEEP_PAIRS = 30 * 86_400_000.0, 0.7, 60, 300
#: Values up to which the model answers, and from which it refuses.
ANSWERED, REFUSED = 120.0, 240.0


def _answers(rows: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return rows.withColumn("w", F.when(b["value"] <= ANSWERED, topic_weight(a, b))).withColumn("refused", b["value"] >= REFUSED)


#: The rule over topics as a model that doesn't always answer, and nearness of values as its local stand-in.
FICKLE = Scorer(MODEL, lambda: [F.col("topic"), F.col("value")], _answers)
NEAR = Scorer(LOCAL, lambda: [F.col("value")], lambda rows: rows.withColumn("w", 1 / (1 + F.abs(F.col("a.value") - F.col("b.value")) / 50)))


def _demanded(spark, sf_dir) -> demand.Demanded:
    """Purchases were scored by the model before, views have a local guess; each eleventh event is held."""
    seg = event_segments(spark, sf_dir)
    before = pairs.scored(seg, TOPICS).where("b.topic IN (3, 5)").withColumns({"topic": F.col("b.topic"), "at": F.col("b.ts")})
    w, source = F.when(F.col("topic") == 3, F.col("w")).otherwise(0.75), F.when(F.col("topic") == 3, MODEL).otherwise(LOCAL)
    scored = before.select("session", "from_idx", "to_idx", w.alias("w"), source.alias("source"), "at")
    seeds = seg.groupBy("session").agg(F.max("idx").alias("seed"), F.max("ts").alias("now"))
    return demand.recall_demand(seg, seeds, scored, FICKLE, STEEP, DEPTH, scale=SLOW, max_pairs=WALK_PAIRS, held=seg.where("event_id % 11 = 0"))


def _demand_sql(depth: int) -> str:
    out = f"""{EV}, {TOPIC}, seed AS (SELECT session, max(idx) AS idx, max(ts) AS newest FROM ev GROUP BY session),
asked AS (SELECT session, idx, least(idx, 16) AS n, topic <> 3 AND event_id % 11 <> 0 AS bought, topic <> 3 AND event_id % 11 = 0 AS held, value <= {ANSWERED} AS answered, topic FROM ev WHERE idx > 0),
arc AS (SELECT *, w * exp(-greatest(0.0, newest - born) / {SLOW}) AS e FROM (
  SELECT sc.session, to_idx, from_idx, newest, born, CASE WHEN topic = 3 OR bought AND answered THEN w WHEN topic = 5 THEN 0.75::DOUBLE END AS w
  FROM sc JOIN asked ON asked.session = sc.session AND asked.idx = to_idx JOIN seed ON seed.session = sc.session) WHERE w * exp(-greatest(0.0, newest - born) / {SLOW}) > {STEEP}),
r0 AS (SELECT session, idx, 0 AS depth, CAST(NULL AS BIGINT) AS via, 1 AS pos FROM seed), u0 AS (SELECT * FROM r0), g0 AS (SELECT * FROM r0),
x0 AS (SELECT session, 'budget' AS stop FROM seed WHERE false), s0 AS (SELECT session, CAST(0 AS BIGINT) AS spent FROM seed)"""
    for k in range(depth):
        out += f""",
c{k} AS (SELECT g.session, {k} AS depth, count(*) FILTER (bought) AS rows, coalesce(sum(n) FILTER (bought), 0) AS pairs, coalesce(sum(n) FILTER (bought AND answered), 0) AS judged, count(*) FILTER (bought AND NOT answered) AS missed,
  coalesce(sum(n) FILTER (bought AND NOT answered), 0) AS missed_pairs, count(*) FILTER (held) AS skipped FROM g{k} g JOIN asked a ON a.session = g.session AND a.idx = g.idx WHERE bought OR held GROUP BY g.session),
s{k + 1} AS (SELECT s.session, spent + coalesce(pairs, 0) AS spent FROM s{k} s LEFT JOIN c{k} c ON c.session = s.session),
f{k + 1} AS (SELECT arc.session, from_idx AS idx, min(ROW(pos, -e, to_idx)) AS best FROM g{k} g JOIN arc ON arc.session = g.session AND to_idx = g.idx ANTI JOIN u{k} u ON u.session = arc.session AND u.idx = from_idx GROUP BY ALL),
r{k + 1} AS (SELECT session, idx, {k + 1} AS depth, best[3] AS via, row_number() OVER (PARTITION BY session ORDER BY best[1], best[2], idx DESC) AS pos FROM f{k + 1}), u{k + 1} AS (SELECT * FROM u{k} UNION ALL SELECT * FROM r{k + 1}),
g{k + 1} AS (SELECT r.* FROM r{k + 1} r JOIN s{k + 1} s ON s.session = r.session WHERE spent < {WALK_PAIRS}),
x{k + 1} AS (SELECT * FROM x{k} UNION ALL SELECT DISTINCT r.session, {"'depth'" if k + 1 == depth else f"'budget' FROM r{k + 1} r JOIN s{k + 1} s ON s.session = r.session WHERE spent >= {WALK_PAIRS}"} {f"FROM r{k + 1} r" if k + 1 == depth else ""})"""
    opened = " UNION ALL ".join(f"SELECT session, idx FROM g{k}" for k in range(depth))
    levels = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(depth))
    return f"""{out},
opened AS ({opened}), levels AS ({levels}),
weights AS (SELECT arc.session, from_idx AS idx, max(e) AS w FROM arc JOIN opened o ON o.session = arc.session AND o.idx = to_idx GROUP BY ALL),
sums AS (SELECT session, sum(rows) AS rows, sum(pairs) AS pairs, sum(judged) AS judged, sum(missed) AS missed, sum(missed_pairs) AS missed_pairs, sum(skipped) AS skipped FROM levels GROUP BY session)"""


DEMAND = _demand_sql(DEPTH)
COUNTERS = ("rows", "pairs", "judged", "missed", "missed_pairs", "skipped")
_LONG = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTERS)


@query(f"WITH {DEMAND} SELECT r.session, r.idx, r.depth, via, CAST(pos AS INTEGER) AS pos, round(w, 6) AS w FROM u{DEPTH} r JOIN weights ON weights.session = r.session AND weights.idx = r.idx WHERE r.depth > 0")
def demand_hits(spark, sf_dir):
    """What a walk finds that scores its own rows."""
    return rounded(_demanded(spark, sf_dir).hits.select("session", "idx", "depth", "via", "pos", "w"), "w")


@query(f"WITH {DEMAND} SELECT session, depth, {_LONG} FROM levels")
def demand_levels(spark, sf_dir):
    """What each level of the walk asked for, and what came back."""
    return _demanded(spark, sf_dir).levels.select("session", "depth", *COUNTERS)


@query(f"WITH {DEMAND} SELECT seed.session, {_LONG}, coalesce(stop, 'complete') AS stop FROM seed LEFT JOIN sums ON sums.session = seed.session LEFT JOIN x{DEPTH} x ON x.session = seed.session")
def demand_stops(spark, sf_dir):
    """What each session's walk paid for and why it ended."""
    return _demanded(spark, sf_dir).sessions.select("session", *[F.col(c).cast("long").alias(c) for c in COUNTERS], "stop")


def _sweep_sql(rows: str, most: int, refused: str, judged: str, weights: str, threshold: float) -> str:
    return f"""{rows},
placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM todo WINDOW w AS (PARTITION BY session ORDER BY anchor, idx)),
stops AS (SELECT session, min(place) AS stop FROM placed WHERE before > 0 AND before + n > {most} GROUP BY session),
paid AS (SELECT placed.* FROM placed LEFT JOIN stops ON stops.session = placed.session WHERE stop IS NULL OR place < stop),
ends AS (SELECT session, min(place) AS e FROM paid WHERE {refused} GROUP BY session),
offered AS (SELECT paid.* FROM paid LEFT JOIN ends ON ends.session = paid.session WHERE e IS NULL OR place < e),
cut AS (SELECT p.session, p.idx AS first FROM placed p LEFT JOIN stops ON stops.session = p.session LEFT JOIN ends ON ends.session = p.session WHERE place = least(stop, e)),
late AS (SELECT p.session, sum(n) AS deferred_pairs, count(*) AS deferred_segments FROM placed p JOIN cut ON cut.session = p.session ANTI JOIN offered o ON o.session = p.session AND o.idx = p.idx WHERE p.idx >= first GROUP BY p.session),
done AS (SELECT session, sum(n) AS scored_pairs, sum(n) FILTER ({judged}) AS judged_pairs FROM offered GROUP BY session),
{weights},
edge AS (SELECT session, count(*) AS edges FROM weighed WHERE w >= {threshold} GROUP BY session)
SELECT a.session, CAST(coalesce(scored_pairs, 0) AS BIGINT) AS scored_pairs, CAST(coalesce(judged_pairs, 0) AS BIGINT) AS judged_pairs, coalesce(edges, 0) AS edges, CAST(coalesce(deferred_pairs, 0) AS BIGINT) AS deferred_pairs, coalesce(deferred_segments, 0) AS deferred_segments
FROM everyone a LEFT JOIN done ON done.session = a.session LEFT JOIN edge ON edge.session = a.session LEFT JOIN late ON late.session = a.session"""


_EVENT_ROWS = f"""{EV}, {TOPIC}, everyone AS (SELECT DISTINCT session FROM ev), todo AS (SELECT session, idx, value, least(idx, 16) AS n, CAST(idx <> max(idx) OVER (PARTITION BY session) AS INT) AS anchor, topic FROM ev WHERE idx > 0 QUALIFY topic <> 3)"""
_EVENT_WEIGHTS = f"""weighed AS (SELECT o.session, CASE WHEN o.value <= {ANSWERED} THEN w ELSE 1 / (1 + abs(a.value - o.value) / 50::DOUBLE) END AS w FROM offered o JOIN sc ON sc.session = o.session AND sc.to_idx = o.idx JOIN ev a ON a.session = o.session AND a.idx = from_idx)"""


@query("WITH " + _sweep_sql(_EVENT_ROWS, SWEEP_PAIRS, f"value >= {REFUSED}", f"value <= {ANSWERED}", _EVENT_WEIGHTS, 0.55))
def sweep_counters(spark, sf_dir):
    """A sweep with a pair budget, from each session's last event; purchases are settled, the model refuses some rows and leaves some."""
    seg = event_segments(spark, sf_dir)
    last = seg.groupBy("session").agg(F.max("idx").alias("idx"))
    return demand.sweep(seg, FICKLE, 0.55, max_pairs=SWEEP_PAIRS, settled=seg.where("topic = 3"), anchors=last, fallback=NEAR).sessions


_TEXT_ROWS = f"{SEG}, {LEX}, everyone AS (SELECT DISTINCT session FROM seg), todo AS (SELECT session, idx, least(idx, 16) AS n, 0 AS anchor FROM seg WHERE idx > 0)"


@query("WITH " + _sweep_sql(_TEXT_ROWS, 12, "false", "false", "weighed AS (SELECT o.session, w FROM offered o JOIN lex ON lex.session = o.session AND lex.to_idx = o.idx)", LOW))
def sweep_local(spark, sf_dir):
    """The same with overlaps of texts for a scorer: nothing is refused and nothing judged."""
    return demand.sweep(messages(spark, sf_dir), LEXICAL, LOW, max_pairs=12).sessions


@query(f"""WITH {_EVENT_ROWS} SELECT session, idx AS to_idx, n AS pairs FROM todo WHERE n > 0""")
def sweep_backlog(spark, sf_dir):
    """Rows that a sweep without a budget scores whole, with the pairs it pays for."""
    seg = event_segments(spark, sf_dir)
    swept = demand.sweep(seg, TOPICS, 0.55, settled=seg.where("topic = 3"), fallback=NEAR)
    return swept.scores.groupBy("session", "to_idx").agg(F.count("*").alias("pairs"))
