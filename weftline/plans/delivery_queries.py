"""Queries over what is visible, contained and delivered: ``conversations`` as sessions, ``documents`` by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import assembly, segments
from weftline.operators.containment import held_lines
from weftline.plans.registry import PLACE, SEG, TOKENS, messages, query, table


@query(r"""WITH l AS (SELECT doc_id, source, text, unnest(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) >= 128))) AS line FROM documents),
found AS (SELECT doc_id, EXISTS (SELECT 1 FROM documents o WHERE coalesce(o.source, '') = coalesce(l.source, '') AND o.doc_id <> l.doc_id AND contains(o.text, l.line)) AS hit FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (hit) AS held FROM found GROUP BY doc_id""")
def contained_lines(spark, sf_dir):
    """How many of a document's different lines of at least 128 characters another document of its source holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("_by"), F.coalesce("text", F.lit("")).alias("_text"))
    lines = docs.select("_by", F.col("doc_id").alias("_doc"), F.explode(F.array_distinct(F.split("_text", "\n"))).alias("_line")).where(F.length("_line") >= 128)
    return held_lines(lines).select(F.col("_doc").alias("doc_id"), "lines", "held")


def _surface(spark, sf_dir):
    """What each session wants (all but its anchor and its pinned segments) and shows (its tail and anchor; in every third session its
    first two wanted ones are quoted by a message that was injected before)."""
    placed = segments.tail_history(messages(spark, sf_dir)).withColumn("parent", F.concat(F.lit("m"), F.col("idx").cast("string")))
    wanted = placed.where("place IN ('history', 'tail')").select("session", "idx", "kind", "parent", "text")
    shown = placed.where("place IN ('tail', 'anchor')").select("session", F.col("parent").alias("id"), "text", F.lit(False).alias("injected"))
    quoted = wanted.where("session % 3 = 0 AND idx < 2").withColumn("_r", assembly.rendered(F.col("kind"), F.col("parent"), F.col("text")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "_r"))), lambda x: x["_r"])
    injected = quoted.groupBy("session").agg(F.array_join(parts, "\n\n").alias("text")).select("session", F.lit("seg-0").alias("id"), "text", F.lit(True).alias("injected"))
    return placed, wanted, shown.unionByName(injected)


SURFACE = f"""{SEG}, {PLACE}, want AS (SELECT session, idx, kind, 'm' || idx AS parent, text, '## earlier ' || kind || ' turn, quoted verbatim · m' || idx || chr(10) || text AS r FROM placed WHERE place IN ('history', 'tail')),
shown AS (SELECT session, 'm' || idx AS id, text, false AS injected FROM placed WHERE place IN ('tail', 'anchor') UNION ALL SELECT session, 'seg-0', string_agg(r, chr(10) || chr(10) ORDER BY idx), true FROM want WHERE session % 3 = 0 AND idx < 2 GROUP BY session),
vis AS (SELECT DISTINCT w.session, w.idx FROM want w JOIN shown s ON s.session = w.session
  WHERE w.text <> '' AND (w.kind IN ('user', 'toolResult') AND (s.text = w.text OR length(w.text) >= 128 AND contains(s.text, w.text)) OR s.id = w.parent AND contains(s.text, w.text) OR s.injected AND contains(s.text, w.r)))"""


@query(f"WITH {SURFACE} SELECT session, idx FROM vis")
def visible_segments(spark, sf_dir):
    _, wanted, shown = _surface(spark, sf_dir)
    return assembly.visible(wanted, shown)


@query(rf"""WITH RECURSIVE {SURFACE}, asked AS (SELECT want.*, (session, idx) IN (SELECT (session, idx) FROM vis) AS vis, {TOKENS.format("(chr(10) || chr(10) || r)")} AS tokens, row_number() OVER (PARTITION BY session ORDER BY idx) AS k FROM want),
fold AS (
  SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS idx, CAST([] AS VARCHAR[]) AS texts, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, '' AS outcome, CAST(NULL AS VARCHAR) AS r, CAST(0 AS BIGINT) AS tokens FROM (SELECT DISTINCT session FROM want)
  UNION ALL SELECT session, k, idx, CASE WHEN o = 'delivered' THEN list_append(texts, text) ELSE texts END, CASE WHEN o = 'delivered' THEN used + tokens ELSE used END, CASE WHEN o = 'delivered' THEN n + 1 ELSE n END, o, r, tokens FROM (
    SELECT a.session, a.k, a.idx, a.text, a.r, a.tokens, fold.texts, fold.used, fold.n, CASE WHEN list_contains(fold.texts, a.text) THEN 'duplicate' WHEN vis THEN 'visible' WHEN fold.used + a.tokens > 120 OR fold.n >= 3 THEN 'deferred' ELSE 'delivered' END AS o
    FROM fold JOIN asked a ON a.session = fold.session AND a.k = fold.k + 1)),
sums AS (SELECT session, count(*) AS candidates, count(*) FILTER (outcome = 'visible') AS visible, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'deferred') AS deferred, count(*) FILTER (outcome = 'delivered') AS delivered,
  CAST(coalesce(sum(tokens) FILTER (outcome = 'delivered'), 0) AS BIGINT) AS tokens, coalesce(string_agg(r, chr(10) || chr(10) ORDER BY idx) FILTER (outcome = 'delivered'), '') AS t FROM fold WHERE k > 0 GROUP BY session),
st AS (SELECT session, session % 7 <> 0 AS enabled, 1 + session % 2 AS step, session % 5 = 0 AS every_step, CASE WHEN session % 4 = 0 THEN 0 ELSE n END AS n, CASE WHEN session % 3 = 1 AND session % 4 <> 0 THEN 1 END AS claimed
  FROM (SELECT session, count(*) FILTER (place IN ('tail', 'anchor')) AS n FROM placed GROUP BY session)),
j AS (SELECT st.*, coalesce(candidates, 0) AS candidates, coalesce(visible, 0) AS visible, coalesce(duplicates, 0) AS duplicates, coalesce(deferred, 0) AS deferred, coalesce(delivered, 0) AS delivered, coalesce(tokens, 0) AS tokens, t FROM st LEFT JOIN sums ON sums.session = st.session),
told AS (SELECT *, CASE WHEN NOT enabled THEN 'off' WHEN step = 1 AND n = 0 THEN 'no step' WHEN n = 0 AND NOT every_step THEN 'no messages' WHEN delivered = 0 AND deferred > 0 THEN 'deferred' WHEN delivered = 0 THEN 'nothing to insert' END AS reason FROM j)
SELECT session, reason, candidates, visible, duplicates, deferred, delivered, tokens, CASE WHEN reason IS NULL THEN 'seg-' || sha256(t) END AS payload, CASE WHEN reason IS NULL THEN coalesce(claimed, n) END AS at FROM told""")
def delivery_plan(spark, sf_dir):
    """What each session's next step is given, or why it is given nothing; within 120 tokens and three segments."""
    placed, wanted, shown = _surface(spark, sf_dir)
    own = F.when(F.col("place").isin("tail", "anchor"), F.struct("idx", F.col("text"), (F.col("session") % 3 == 1).alias("_c")))
    lists = placed.groupBy("session").agg(F.sort_array(F.collect_list(own)).alias("_m"))
    # the first of a session's messages is claimed in every third session
    told = F.transform("_m", lambda m, i: F.struct(m["text"].alias("text"), (m["_c"] & (i == 0)).alias("claimed")))
    steps = lists.select(
        "session", (F.col("session") % 7 != 0).alias("enabled"), (1 + F.col("session") % 2).alias("step"), (F.col("session") % 5 == 0).alias("every_step"), F.when(F.col("session") % 4 == 0, F.slice(told, 1, 0)).otherwise(told).alias("messages")
    )
    return assembly.delivery(steps, wanted, shown, 120, 3)
