"""The library's queries over the driver's tables, each with the SQL that says what it returns.

``conversations`` is the message log (session = conv_id), ``events`` the control log (session = user_id), ``labels`` two binary
arms. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import costs, stats, text
from weftline.operators import assembly, chunker, matrix, paired, pairs, quality, recall, rollup, segments, timejoin
from weftline.plans.registry import DEPTH, EV, HIGH, LEX, LOW, PLACE, SCALE, SEG, SETS, TOKENS, TOPIC, WALK, event_segments, messages, query, rounded, table

# ---- texts and segments


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, turn, CAST(len({SETS.format('text')}) AS BIGINT) AS n FROM conversations")
def token_set_size(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.token_set(F.col("text"))).cast("long").alias("n"))


@query(f"WITH {SEG}, {LEX} SELECT session, from_idx, to_idx, round(w, 6) AS w FROM lex")
def overlap_score(spark, sf_dir):
    return rounded(pairs.lexical_scores(messages(spark, sf_dir)).drop("source"), "w")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?。！？]([")\]}'']*)\s+')) AS BIGINT) AS cuts FROM documents""")
def sentence_cuts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sentence_cuts(F.col("text")).alias("cuts"))


@query()
def block_chunks(spark, sf_dir):
    return chunker.chunked(table(spark, sf_dir, "documents"), "doc_id", "text").select("chunk_id", "chunk", "chunk_of", "tokens", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {SEG} SELECT session, idx, seq, kind, role, tokens, kind <> 'systemPinned' AS input FROM seg")
def segment_index(spark, sf_dir):
    return messages(spark, sf_dir).select("session", "idx", "seq", "kind", "role", "tokens", segments.is_input(F.col("kind")).alias("input"))


@query(f"WITH {EV} SELECT session, event_id, idx, topic FROM ev")
def event_index(spark, sf_dir):
    return event_segments(spark, sf_dir).select("session", "event_id", "idx", "topic")


@query(f"WITH {SEG} SELECT session, idx, CASE WHEN length(text) > 256 THEN left(text, 256) || '...' ELSE text END AS prompt, 'seg-' || sha256(text) AS payload FROM seg")
def rendered_segments(spark, sf_dir):
    return messages(spark, sf_dir).select("session", "idx", text.clipped(F.col("text")).alias("prompt"), text.payload_id("seg-", F.col("text")).alias("payload"))


@query(f"""WITH {SEG}, p AS (SELECT session, idx, text, lag(text) OVER (PARTITION BY session ORDER BY idx) AS before FROM seg)
SELECT session, idx, CASE WHEN text = before THEN 'identical' WHEN regexp_replace(text, '\\r?\\n$', '') = regexp_replace(before, '\\r?\\n$', '') THEN 'identical-except-final-line-ending' ELSE 'different' END AS verdict,
  (SELECT min(i) - 1 FROM unnest(range(1, greatest(length(text), length(before)) + 1)) t(i) WHERE substr(text, i, 1) <> substr(before, i, 1)) AS first_difference FROM p WHERE before IS NOT NULL""")
def turn_differences(spark, sf_dir):
    before = F.lag("text").over(W.partitionBy("session").orderBy("idx"))
    rows = messages(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return rows.select("session", "idx", text.byte_verdict(F.col("text"), F.col("before")).alias("verdict"), text.first_difference(F.col("text"), F.col("before")).cast("long").alias("first_difference"))


@query(f"WITH {SEG} SELECT kind, CASE WHEN kind IN ('user', 'assistant', 'trace', 'toolCall', 'toolResult', 'systemPinned') THEN 'segment' ELSE 'unknown' END AS verdict, count(*) AS n FROM seg GROUP BY ALL UNION ALL SELECT event_type, 'unknown', count(*) FROM events GROUP BY ALL")
def provenance_gate(spark, sf_dir):
    rows = messages(spark, sf_dir).select("kind").union(table(spark, sf_dir, "events").select("event_type"))
    return segments.provenance(rows, "kind")


# ---- pairs


@query(f"WITH {EV} SELECT b.session, a.idx AS from_idx, b.idx AS to_idx FROM ev a JOIN ev b ON a.session = b.session AND a.idx BETWEEN b.idx - 16 AND b.idx - 1")
def window_pairs(spark, sf_dir):
    return pairs.candidates(event_segments(spark, sf_dir), []).select("session", "from_idx", "to_idx")


@query(f"WITH {EV}, w AS (SELECT unnest([16, 64, 256]) AS w) SELECT session, w, count(*) AS segments, CAST(sum(least(idx, w)) AS BIGINT) AS pairs FROM ev, w GROUP BY ALL")
def offered_pairs(spark, sf_dir):
    return pairs.offered(event_segments(spark, sf_dir), [16, 64, 256])


@query(f"WITH {EV}, w AS (SELECT unnest([4, 16, 64, 256]) AS w) SELECT w, CAST(sum(least(idx, w)) AS BIGINT) AS pairs, max(least(idx, w)) AS most, round(sum(least(idx, w)) / sum(idx), 6) AS share FROM ev, w GROUP BY w")
def saving_curve(spark, sf_dir):
    return rounded(pairs.saving_curve(event_segments(spark, sf_dir), [4, 16, 64, 256]), "share")


def _user_scores(spark, sf_dir):
    """Scores that are settled: those into user turns."""
    seg = messages(spark, sf_dir)
    into = seg.where("kind = 'user'").select("session", F.col("idx").alias("to_idx"))
    return seg, pairs.lexical_scores(seg).join(into, ["session", "to_idx"], "left_semi")


@query(f"""WITH {SEG}, {LEX}, st AS (SELECT lex.session, CASE WHEN kind <> 'user' THEN 'unsettled' WHEN w >= 0.2 THEN 'edge' ELSE 'rejected' END AS state FROM lex JOIN seg ON seg.session = lex.session AND seg.idx = to_idx)
SELECT session, state, count(*) AS n FROM st GROUP BY ALL""")
def pair_states(spark, sf_dir):
    seg, scores = _user_scores(spark, sf_dir)
    return pairs.pair_states(pairs.candidates(seg, []).select("session", "from_idx", "to_idx"), scores, LOW).groupBy("session", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, {LEX}, e AS (SELECT * FROM lex WHERE w >= 0.2), d AS (SELECT session, unnest([from_idx, to_idx]) AS idx FROM e)
SELECT seg.session, seg.idx, count(d.idx) AS degree, count(d.idx) = 0 AS dead FROM seg LEFT JOIN d ON d.session = seg.session AND d.idx = seg.idx WHERE kind = 'user' GROUP BY ALL""")
def anchor_degrees(spark, sf_dir):
    seg = messages(spark, sf_dir)
    degree = pairs.degrees(pairs.edges(pairs.lexical_scores(seg), LOW))
    return seg.where("kind = 'user'").select("session", "idx").join(degree, ["session", "idx"], "left").select("session", "idx", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("degree").isNull().alias("dead"))


def _score_log(spark, sf_dir):
    """A log of scores as they came: the lane's for newer topics, lexical ones for all, some pairs reversed."""
    sc = pairs.topic_scores(event_segments(spark, sf_dir))
    even = F.col("from_idx") % 2
    log = lambda a, b, source, pos: F.struct(F.col(a).alias("from_idx"), F.col(b).alias("to_idx"), F.lit(source).alias("source"), pos.cast("double").alias("pos"))
    lane, lexical = log("to_idx", "from_idx", "s1-noul", F.col("to_idx") * 100 + even), log("from_idx", "to_idx", "lexical", F.col("to_idx") * 100 + 1 - even + F.lit(0.5))
    return sc.select("session", F.inline(F.when(F.col("w") > 0.5, F.array(lane, lexical)).otherwise(F.array(lexical))))


@query(f"""WITH {EV}, {TOPIC}, log AS (SELECT session, to_idx AS from_idx, from_idx AS to_idx, 's1-noul' AS source, to_idx * 100 + from_idx % 2 AS pos FROM sc WHERE w > 0.5
  UNION ALL SELECT session, from_idx, to_idx, 'lexical', to_idx * 100 + 1 - from_idx % 2 + 0.5  FROM sc),
f AS (SELECT session, least(from_idx, to_idx) AS a, greatest(from_idx, to_idx) AS b, arg_min(source, pos) AS source FROM log GROUP BY ALL),
o AS (SELECT session, CAST(sum(least(idx, 16)) AS BIGINT) AS offered FROM ev GROUP BY session)
SELECT f.session, count(*) AS pairs, count(*) FILTER (source = 's1-noul') AS lane, count(*) FILTER (source = 'lexical') AS lexical, any_value(offered) AS offered, round(count(*) / any_value(offered), 6) AS coverage FROM f JOIN o ON o.session = f.session GROUP BY f.session""")
def settled_coverage(spark, sf_dir):
    offer = pairs.offered(event_segments(spark, sf_dir), [16]).select("session", F.col("pairs").alias("offered"))
    return rounded(pairs.settled(_score_log(spark, sf_dir)).join(offer, "session").withColumn("coverage", F.try_divide("pairs", "offered")), "coverage")


@query(f"""WITH {EV}, d AS (SELECT session, CASE WHEN session % 2 = 0 THEN 16 * (1 + session % 3) ELSE 5 END AS deferred FROM ev GROUP BY session),
b AS (SELECT ev.session, idx, deferred, sum(least(idx, 16)) OVER (PARTITION BY ev.session ORDER BY idx DESC) AS l FROM ev JOIN d ON d.session = ev.session)
SELECT session, deferred, max(CASE WHEN l = deferred AND deferred > 0 THEN idx END) AS first_refused FROM b GROUP BY ALL""")
def first_refusal(spark, sf_dir):
    seg = event_segments(spark, sf_dir)
    deferred = seg.select("session").distinct().withColumn("deferred", F.when(F.col("session") % 2 == 0, 16 * (1 + F.col("session") % 3)).otherwise(5))
    return pairs.first_refusal(seg, deferred)


# ---- recall


def _walk(spark, sf_dir):
    seg = event_segments(spark, sf_dir)
    seeds = seg.groupBy("session").agg(F.max("idx").alias("seed"), F.max("ts").alias("now"))
    return recall.recall(seeds, recall.walkable(pairs.topic_scores(seg), seeds, HIGH, SCALE), DEPTH)


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT session, idx, depth FROM hits")
def recall_reach(spark, sf_dir):
    return _walk(spark, sf_dir).select("session", "idx", "depth")


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT hits.session, hits.idx, round(w, 6) AS w FROM hits JOIN weights ON weights.session = hits.session AND weights.idx = hits.idx")
def recall_weight(spark, sf_dir):
    return rounded(_walk(spark, sf_dir).select("session", "idx", "w"), "w")


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT session, idx, via, depth, pos FROM hits")
def recall_tree(spark, sf_dir):
    return _walk(spark, sf_dir).select("session", "idx", "via", "depth", "pos")


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT hits.session, hits.idx, row_number() OVER (PARTITION BY hits.session ORDER BY w DESC, depth, pos) AS place FROM hits JOIN weights ON weights.session = hits.session AND weights.idx = hits.idx")
def recall_order(spark, sf_dir):
    hits = _walk(spark, sf_dir)
    return hits.select("session", "idx", recall.ordered(hits).alias("place"))


@query(f"WITH {EV}, {TOPIC}, {WALK} SELECT session, count(*) FILTER (idx >= via) AS forward, count(*) FILTER (idx < via) AS backward FROM hits GROUP BY session")
def forward_audit(spark, sf_dir):
    return recall.forward_audit(_walk(spark, sf_dir))


# ---- assembly


@query(f"WITH {SEG}, {PLACE} SELECT session, place, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM placed GROUP BY ALL")
def tail_history_split(spark, sf_dir):
    return segments.tail_history(messages(spark, sf_dir)).groupBy("session", "place").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def _assembled(spark, sf_dir, threshold: float, source: str):
    placed = segments.tail_history(messages(spark, sf_dir))
    scores = pairs.lexical_scores(placed).withColumn("source", F.lit(source))
    seeds = placed.where("place = 'anchor'").select("session", F.col("idx").alias("seed"))
    hits = recall.recall(seeds, recall.walkable(scores, seeds, threshold), DEPTH)
    judged = pairs.candidates(placed, []).select("session", "from_idx", "to_idx", F.lit(source).alias("source"))
    return placed, assembly.selected(placed, hits, judged, pairs.WINDOW)


def _chosen_sql(threshold: float, judged: bool) -> str:
    admitted = "SELECT NULL AS session, NULL AS idx, NULL AS tokens WHERE false" if judged else "SELECT h.session, h.idx, h.tokens FROM hist h JOIN anchor a ON a.session = h.session WHERE h.idx BETWEEN a.idx - 16 AND a.idx - 1 AND h.session NOT IN (SELECT session FROM hit)"
    return f"""anchor AS (SELECT session, idx FROM placed WHERE place = 'anchor'), hist AS (SELECT session, idx, tokens FROM placed WHERE place = 'history'),
walk AS (SELECT session, idx, 0 AS depth FROM anchor UNION SELECT walk.session, from_idx, depth + 1 FROM walk JOIN lex ON lex.session = walk.session AND lex.to_idx = walk.idx WHERE w > {threshold} AND depth < {DEPTH}),
hit AS (SELECT DISTINCT session, idx FROM walk WHERE depth > 0),
found AS (SELECT hist.* FROM hist JOIN hit ON hit.session = hist.session AND hit.idx = hist.idx), adm AS ({admitted}),
enough AS (SELECT session FROM found UNION SELECT session FROM adm),
chosen AS (SELECT session, idx, tokens, 'recalled' AS why FROM found UNION ALL SELECT session, idx, tokens, 'unjudged' FROM adm UNION ALL SELECT session, idx, tokens, 'recency' FROM hist WHERE session NOT IN (SELECT session FROM enough))"""


@query(f"WITH RECURSIVE {SEG}, {LEX}, {PLACE}, {_chosen_sql(HIGH, False)} SELECT session, idx, tokens, why FROM chosen")
def fail_open_window(spark, sf_dir):
    return _assembled(spark, sf_dir, HIGH, "lexical")[1]


@query(f"WITH RECURSIVE {SEG}, {LEX}, {PLACE}, {_chosen_sql(LOW, True)} SELECT session, idx, tokens, why FROM chosen")
def recency_fallback(spark, sf_dir):
    return _assembled(spark, sf_dir, LOW, "s1-noul")[1]


@query(f"""WITH RECURSIVE {SEG}, {LEX}, {PLACE}, {_chosen_sql(LOW, False)},
b AS (SELECT session, coalesce(sum(tokens) FILTER (place = 'pinned'), 0) AS pinned, coalesce(sum(tokens) FILTER (place = 'tail'), 0) AS tail, coalesce(sum(tokens) FILTER (place = 'anchor'), 0) AS anchor, coalesce(sum(tokens) FILTER (place = 'history'), 0) AS history FROM placed GROUP BY session),
c AS (SELECT session, sum(tokens) AS recalled, max(why) AS why FROM chosen GROUP BY session),
j AS (SELECT b.*, coalesce(recalled, 0) AS recalled, why FROM b LEFT JOIN c ON c.session = b.session)
SELECT session, CAST(pinned AS BIGINT) AS pinned, CAST(tail AS BIGINT) AS tail, CAST(recalled AS BIGINT) AS recalled, CAST(anchor AS BIGINT) AS anchor, why, CAST(pinned + tail + recalled + anchor AS BIGINT) AS used, CAST(30000 AS BIGINT) AS total,
  CAST(pinned + tail AS BIGINT) AS stable, CAST(recalled + anchor AS BIGINT) AS after_cut, CAST(greatest(0, history - recalled) AS BIGINT) AS would_save FROM j""")
def assembly_budget(spark, sf_dir):
    placed, chosen = _assembled(spark, sf_dir, LOW, "lexical")
    return assembly.budget(placed, chosen, 32_768, 2_768)


@query(f"""WITH RECURSIVE {SEG}, {LEX}, {PLACE}, {_chosen_sql(LOW, False)}, want AS (SELECT chosen.session, chosen.idx, seg.text FROM chosen JOIN seg ON seg.session = chosen.session AND seg.idx = chosen.idx)
SELECT session, min(idx) AS idx, 'seg-' || sha256(text) AS payload FROM want WHERE (session, text) NOT IN (SELECT (session, text) FROM placed WHERE place IN ('tail', 'anchor')) GROUP BY session, text""")
def delta_delivery(spark, sf_dir):
    placed, chosen = _assembled(spark, sf_dir, LOW, "lexical")
    wanted = chosen.select("session", "idx").join(placed.select("session", "idx", "text"), ["session", "idx"])
    return assembly.missing(wanted, placed.where("place IN ('tail', 'anchor')")).select("session", "idx", "payload")


@query(f"""WITH RECURSIVE {SEG}, fold AS (
  SELECT session, idx, tokens, tokens <= 300 AS delivered, CASE WHEN tokens <= 300 THEN tokens ELSE 0 END AS used, CAST(tokens <= 300 AS INT) AS n FROM seg WHERE idx = 0
  UNION ALL SELECT s.session, s.idx, s.tokens, used + s.tokens <= 300 AND n < 4, CASE WHEN used + s.tokens <= 300 AND n < 4 THEN used + s.tokens ELSE used END, CASE WHEN used + s.tokens <= 300 AND n < 4 THEN n + 1 ELSE n END
  FROM fold JOIN seg s ON s.session = fold.session AND s.idx = fold.idx + 1)
SELECT session, idx, idx AS pos, tokens, delivered FROM fold""")
def delivery_budget(spark, sf_dir):
    seg = messages(spark, sf_dir).withColumn("pos", F.col("idx"))
    return assembly.within_budget(seg, 300, 4)


@query(f"""WITH {SEG} SELECT a.session, a.kind AS parent, a.idx, NOT EXISTS (SELECT 1 FROM seg b WHERE b.session = a.session AND b.kind = a.kind AND b.idx < a.idx AND contains(b.text, a.text)) AS kept FROM seg a""")
def sibling_redundancy(spark, sf_dir):
    """Whole texts of each session; siblings are those of one kind."""
    return assembly.not_contained(messages(spark, sf_dir).withColumn("parent", F.col("kind")).withColumn("pos", F.col("idx")))


@query(f"""WITH {EV}, s AS (SELECT session, idx // 4 AS step, topic AS idx FROM ev GROUP BY ALL), f AS (SELECT session, idx, min(step) AS f FROM s GROUP BY ALL)
SELECT s.session, step, s.idx, row_number() OVER (PARTITION BY s.session, step ORDER BY f, s.idx) AS place FROM s JOIN f ON f.session = s.session AND f.idx = s.idx""")
def first_selection_order(spark, sf_dir):
    steps = event_segments(spark, sf_dir).select("session", F.floor(F.col("idx") / 4).alias("step"), F.col("topic").alias("idx")).distinct()
    return assembly.selection_order(steps)


@query(f"""WITH {EV}, r AS (SELECT session, idx, 1 + CAST(floor(value) AS BIGINT) AS tokens FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx DESC) AS r, sum(tokens) OVER (PARTITION BY session) AS total FROM r),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY session) AS save FROM k WHERE r > 3 AND (session, idx) IN (SELECT (session, idx) FROM ev WHERE event_type = 'error'))
SELECT session, idx, tokens FROM c WHERE save >= 64 AND save >= 0.05 * total""")
def tool_context_selection(spark, sf_dir):
    seg = event_segments(spark, sf_dir)
    rows = seg.select("session", "idx", (1 + F.floor("value")).cast("long").alias("tokens"))
    return assembly.shortenable(rows, seg.where("event_type = 'error'"), 3, 64, 0.05)


PLANS = "plans AS (SELECT conv_id AS set_id, turn AS id, CASE WHEN conv_id % 7 = 0 THEN -1.0 WHEN turn % 4 = 3 THEN CAST('NaN' AS DOUBLE) ELSE length(text) / 100.0 END AS score, 0.2 + (conv_id % 5) * 0.15 AS confidence FROM conversations)"


@query(f"""WITH {PLANS}, g AS (SELECT *, CASE WHEN NOT isnan(score) AND score > 0 THEN score END AS good FROM plans),
s AS (SELECT *, sum(good) OVER (PARTITION BY set_id) AS total, count(*) OVER (PARTITION BY set_id) AS n, max(confidence) OVER (PARTITION BY set_id) AS best FROM g),
p AS (SELECT set_id, id, CASE WHEN total > 0 THEN coalesce(good, 0.0) / total ELSE 1 / n END AS p, best < 0.5 OR total IS NULL AS abstained FROM s)
SELECT set_id, id, round(p, 6) AS p, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN abstained THEN 0.0 ELSE -p END, id) AS place, abstained FROM p""")
def plan_order(spark, sf_dir):
    nan = F.lit(float("nan"))
    score = F.when(F.col("conv_id") % 7 == 0, -1.0).when(F.col("turn") % 4 == 3, nan).otherwise(F.length("text") / 100.0)
    plans = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("id"), score.alias("score"), (0.2 + (F.col("conv_id") % 5) * 0.15).alias("confidence"))
    return rounded(assembly.plan_order(plans, 0.5), "p")


# ---- time joins and roll-ups

STEP = "fr AS (SELECT session, idx, ts AS s, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) - 60000 AS e FROM ev WHERE event_type = 'view')"


@query(f"""WITH {EV}, {STEP}, x AS (SELECT ev.session, event_id, min(fr.idx) AS step FROM ev LEFT JOIN fr ON fr.session = ev.session AND ev.ts BETWEEN s AND coalesce(e, 4611686018427387904) WHERE event_type <> 'view' GROUP BY ALL),
l AS (SELECT session, min(s) AS a, max(coalesce(e, 4611686018427387904)) AS b FROM fr GROUP BY session)
SELECT x.session, x.event_id, step, CASE WHEN step IS NOT NULL THEN 'step' WHEN a IS NULL OR ev.ts < a THEN 'pre' WHEN ev.ts > b THEN 'tail' ELSE 'idle' END AS scope FROM x JOIN ev ON ev.event_id = x.event_id LEFT JOIN l ON l.session = x.session""")
def interval_attribution(spark, sf_dir):
    ev = event_segments(spark, sf_dir)
    end = F.lead("ts").over(W.partitionBy("session").orderBy("ts", "event_id")) - 60_000
    views = ev.where("event_type = 'view'")
    frames = views.select("session", F.col("idx").alias("step"), F.col("ts").alias("start"), end.alias("end")).where("end IS NULL OR end >= start")
    return timejoin.attribute(ev.where("event_type <> 'view'").select("session", "ts", "event_id"), frames, "session", "step").select("session", "event_id", "step", "scope")


@query(f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), v AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT c.session, c.event_id, CASE WHEN v.ts - c.ts <= 86400000 THEN v.event_id END AS next_id, CASE WHEN v.ts - c.ts <= 86400000 THEN v.ts - c.ts END AS wait FROM c ASOF LEFT JOIN v ON v.session = c.session AND v.ts >= c.ts""")
def asof_next_step(spark, sf_dir):
    ev = event_segments(spark, sf_dir)
    right = ev.where("event_type = 'view'").select("session", "ts", F.col("event_id").alias("next_id"))
    return timejoin.asof(ev.where("event_type = 'click'").select("session", "ts", "event_id"), right, "session", ["next_id"], forward=True, tolerance=86_400_000).select("session", "event_id", "next_id", (F.col("matched_ts") - F.col("ts")).alias("wait"))


@query(f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'purchase'), v AS (SELECT * FROM ev WHERE event_type = 'click')
SELECT c.session, c.event_id, CASE WHEN c.ts - v.ts <= 86400000 THEN v.event_id END AS before_id FROM c ASOF LEFT JOIN v ON v.session = c.session AND v.ts <= c.ts""")
def asof_prev_invocation(spark, sf_dir):
    ev = event_segments(spark, sf_dir)
    right = ev.where("event_type = 'click'").select("session", "ts", F.col("event_id").alias("before_id"))
    return timejoin.asof(ev.where("event_type = 'purchase'").select("session", "ts", "event_id"), right, "session", ["before_id"], tolerance=86_400_000).select("session", "event_id", "before_id")


@query(f"""WITH {EV}, a AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) AS k FROM ev WHERE event_type = 'click'), b AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts) AS k FROM ev WHERE event_type = 'view')
SELECT a.session, a.ts AS left_ts, b.ts AS right_ts FROM a JOIN b ON a.session = b.session AND a.k = b.k WHERE abs(a.ts - b.ts) <= 172800000""")
def kth_occurrence(spark, sf_dir):
    ev = event_segments(spark, sf_dir).select("session", "ts", "event_type")
    return timejoin.kth_match(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), ["session"], 172_800_000)


STEPPED = """o AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM ev),
facts AS (SELECT *, sum(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY session, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM o)"""
ROLLED = """rolled AS (SELECT session, turn, step, CASE grouping_id(session, turn, step) WHEN 3 THEN 'cell' WHEN 1 THEN 'turn' ELSE CASE WHEN step = 0 THEN 'gap' ELSE 'step' END END AS scope,
  count(*) AS records, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, min(ts) AS first_ts, max(ts) AS last_ts FROM facts GROUP BY GROUPING SETS ((session), (session, turn), (session, turn, step)))"""


@query(f"WITH {EV}, {STEPPED}, {ROLLED} SELECT session, CAST(turn AS BIGINT) AS turn, CAST(step AS BIGINT) AS step, scope, records, errors, cents, first_ts, last_ts FROM rolled")
def scope_rollup(spark, sf_dir):
    return rollup.scopes(rollup.stepped(event_segments(spark, sf_dir)))


@query(f"""WITH {EV}, {STEPPED}, {ROLLED} SELECT session, scope, CAST(turn AS BIGINT) AS turn, CAST(step AS BIGINT) AS step, metric, value FROM
  (UNPIVOT (SELECT session, scope, turn, step, records, errors, cents, first_ts, last_ts FROM rolled) ON records, errors, cents, first_ts, last_ts INTO NAME metric VALUE value)""")
def long_report(spark, sf_dir):
    return rollup.long_format(rollup.scopes(rollup.stepped(event_segments(spark, sf_dir))))


@query(f"""WITH {EV}, {STEPPED}, {ROLLED}, r AS (SELECT session, count(*) AS records, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM ev GROUP BY session),
p AS (SELECT session, CAST(sum(records) AS BIGINT) AS records, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(cents) AS BIGINT) AS cents FROM rolled WHERE scope IN ('step', 'gap') GROUP BY session),
x AS (SELECT session, metric, value AS raw FROM (UNPIVOT r ON records, errors, cents INTO NAME metric VALUE value)), y AS (SELECT session, metric, value AS steps FROM (UNPIVOT p ON records, errors, cents INTO NAME metric VALUE value))
SELECT x.session, x.metric, raw, steps, raw - coalesce(steps, 0) AS difference FROM x LEFT JOIN y ON y.session = x.session AND y.metric = x.metric""")
def reconcile_check(spark, sf_dir):
    facts = rollup.stepped(event_segments(spark, sf_dir))
    return rollup.reconciled(rollup.scopes(facts), facts)


@query(f"""WITH {EV}, p AS (SELECT *, lag(event_type) OVER w AS t, lag(event_id) OVER w AS i, lag(ts) OVER w AS b FROM ev WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
SELECT session, CASE WHEN t = 'click' THEN i END AS call_id, event_id AS result_id, CASE WHEN t = 'click' THEN ts - b END AS ms FROM p WHERE event_type = 'view'""")
def call_result_latency(spark, sf_dir):
    return rollup.call_latency(event_segments(spark, sf_dir), "click", "view")


CALLS = "calls AS (SELECT session, idx, 10 * CAST(round(value * 100) AS BIGINT) AS cached, CAST(round(value * 100) AS BIGINT) + idx AS uncached, idx % 50 AS output FROM ev)"


def _calls(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return event_segments(spark, sf_dir).select("session", "idx", (cents * 10).alias("cached"), (cents + F.col("idx")).alias("uncached"), (F.col("idx") % 50).alias("output"))


@query(f"""WITH {EV}, {CALLS}, g AS (SELECT session, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(uncached) AS BIGINT) AS uncached, CAST(sum(output) AS BIGINT) AS output FROM calls GROUP BY session)
SELECT *, round(CASE WHEN cached + uncached = 0 THEN 0 ELSE cached / (cached + uncached) END, 6) AS hit_rate, round((cached * 0.07 + uncached * 0.27 + output * 1.1) / 1000000, 6) AS usd FROM g""")
def cost_summary(spark, sf_dir):
    return rounded(rollup.cost_summary(_calls(spark, sf_dir), costs.PRICES["base"], ["session"]), "hit_rate", "usd")


@query(f"""WITH {EV}, {CALLS}, h AS (SELECT session, idx, uncached AS removed, cached AS after, 1 + idx % 8 AS steps, (idx % 5) / 4 AS h FROM calls)
SELECT session, idx, round(steps * removed * (h * 0.07 + (1 - h) * 0.27), 6) AS saving, round(after * h * (0.27 - 0.07), 6) AS loss, round(steps * removed * (h * 0.07 + (1 - h) * 0.27), 6) > round(after * h * (0.27 - 0.07), 6) AS adopt,
  CASE WHEN h * after > 0 THEN round(removed / (h * after), 6) END AS ratio, round((0.27 - 0.07) / (h * 0.07 + (1 - h) * 0.27), 6) AS break_even, CAST(floor(after / 64) * 64 AS BIGINT) AS aligned FROM h""")
def reselect_decision(spark, sf_dir):
    rows = _calls(spark, sf_dir).select("session", "idx", F.col("uncached").alias("removed"), F.col("cached").alias("after"), (1 + F.col("idx") % 8).alias("steps"), ((F.col("idx") % 5) / 4).alias("h"))
    hit, miss = F.lit(0.07), F.lit(0.27)
    got = costs.reselect(F.col("removed"), F.col("after"), F.col("steps"), F.col("h"), hit, miss)
    out = rows.select("session", "idx", F.round(got["saving"], 6).alias("saving"), F.round(got["loss"], 6).alias("loss"), F.round(got["ratio"], 6).alias("ratio"), F.round(costs.break_even_ratio(F.col("h"), hit, miss), 6).alias("break_even"), costs.aligned(F.col("after")).alias("aligned"))
    return out.withColumn("adopt", F.col("saving") > F.col("loss")).withColumn("ratio", F.when(F.col("ratio") < float("inf"), F.col("ratio")))


@query(f"""WITH {EV}, c AS (SELECT session, left('kind ' || CAST(floor(value / 10) AS BIGINT), 120) AS m, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY ALL)
SELECT session, CAST(sum(n) AS BIGINT) AS errors, count(*) AS kinds, arg_min(m, ROW(-n, m)) AS top_error, max(n) AS top_count FROM c GROUP BY session""")
def error_histogram(spark, sf_dir):
    ev = event_segments(spark, sf_dir).where("event_type = 'error'")
    return rollup.error_histogram(ev, "session", F.concat(F.lit("kind "), F.floor(F.col("value") / 10).cast("string")))


@query(f"WITH {EV} SELECT session, CASE WHEN count(DISTINCT topic) = 1 THEN min(topic) END AS topic FROM ev GROUP BY session")
def knob_conflicts(spark, sf_dir):
    return rollup.conflict_free(event_segments(spark, sf_dir), "session", "topic")


ACTIVITY = "cells AS (SELECT a.session, a.idx, b.idx AS invocation, CASE WHEN a.idx = b.idx THEN 'root' WHEN a.idx > b.idx THEN 'absent' WHEN a.idx >= b.idx - 16 THEN 'candidate' ELSE 'existed' END AS state FROM ev a JOIN ev b ON a.session = b.session WHERE b.event_type = 'click')"


@query(f"WITH {EV}, {ACTIVITY} SELECT session, state, count(*) AS n FROM cells GROUP BY ALL")
def activity_matrix(spark, sf_dir):
    ev = event_segments(spark, sf_dir)
    return matrix.activity_counts(ev, ev.where("event_type = 'click'"), 16)


@query(f"""WITH {EV}, {ACTIVITY} SELECT session, CAST(floor(idx / 8) AS BIGINT) AS row, CAST(floor(invocation / 8) AS BIGINT) AS col, ['absent', 'existed', 'candidate', 'root'][max(list_position(['absent', 'existed', 'candidate', 'root'], state))] AS state, count(*) AS cells FROM cells GROUP BY 1, 2, 3""")
def block_rollup(spark, sf_dir):
    ev = event_segments(spark, sf_dir)
    return matrix.tiles(ev, ev.where("event_type = 'click'"), 16, 8, 8)


# ---- statistics


def _arms(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return labels.select("lang", F.col("quality").alias("x"), F.col("toxic").alias("y"), "doc_id")


BC = "bc AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


@query(f"WITH {BC} SELECT lang, n, b, c, b + c >= 25 AND least(b, c) >= 5 AS asymptotic_fits, sign(b - c) AS sign FROM bc")
def paired_discordant(spark, sf_dir):
    counts = paired.discordance(_arms(spark, sf_dir), ["lang"])
    return paired.tested(counts).select("lang", "n", "b", "c", "asymptotic_fits", F.col("sign").cast("int").alias("sign"))


EXACT = "least(1.0, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) t(i)))"


@query(f"WITH {BC} SELECT lang, b, c, round({EXACT}, 6) AS p_one, round(least(1.0, 2 * {EXACT}), 6) AS p_two FROM bc")
def mcnemar_exact(spark, sf_dir):
    """The test of all discordant pairs of each language."""
    return rounded(paired.tested(paired.discordance(_arms(spark, sf_dir), ["lang"])).select("lang", "b", "c", "p_one", "p_two"), "p_one", "p_two")


@query(f"WITH {BC} SELECT lang, b + c AS discordant, round((1.959963984540054 + 0.8416212335729143) / sqrt(b + c), 6) AS difference, (1.959963984540054 + 0.8416212335729143) / sqrt(b + c) <= 1 AS resolvable FROM bc WHERE b + c > 0")
def detectable_difference(spark, sf_dir):
    found = paired.discordance(_arms(spark, sf_dir), ["lang"]).select("lang", (F.col("b") + F.col("c")).alias("discordant")).where("discordant > 0")
    return rounded(found.withColumn("difference", stats.detectable(F.col("discordant"))).withColumn("resolvable", F.col("difference") <= 1), "difference")


@query(f"WITH {BC}, z AS (SELECT lang, ((b - c) / (b + c) + 0.1) * sqrt(b + c) AS z FROM bc WHERE b + c > 0) SELECT lang, round(z, 6) AS z, z > 1.6448536269514722 AS holds FROM z")
def margin_test(spark, sf_dir):
    """Whether the first arm is no worse than the second by a margin of 0.1 of the discordant pairs, at 5 per cent."""
    found = paired.discordance(_arms(spark, sf_dir), ["lang"]).where("b + c > 0")
    b, c = F.col("b"), F.col("c")
    return rounded(found.select("lang", stats.margin_statistic(b, c, 0.1).alias("z"), (stats.shifted_margin(b, c, 0.1) < 0.05).alias("holds")), "z")


@query("""WITH c AS (SELECT lang, count(DISTINCT doc_id) FILTER (quality = 1 AND toxic = 0) AS tp, count(DISTINCT doc_id) FILTER (quality = 1 AND toxic = 1) AS fp, count(DISTINCT doc_id) FILTER (quality <> 1 AND toxic = 0) AS fn
FROM labels JOIN documents USING (doc_id) GROUP BY lang), s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c)
SELECT lang, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM s""")
def set_quality(spark, sf_dir):
    """How well the documents of good quality predict those that are not toxic."""
    arms = _arms(spark, sf_dir)
    return rounded(quality.set_quality(arms.where("x = 1"), arms.where("y = 0"), "doc_id", "lang"), "precision", "recall", "f1")


@query("""WITH p AS (SELECT lang AS name, count(*) FILTER (n_chars > 2000) / count(*) / 4 AS p FROM documents GROUP BY lang), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS k FROM p),
a AS (SELECT *, max(least(1.0, (k - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS adjusted FROM k) SELECT name, round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS reject FROM a""")
def holm_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg((F.count_if(F.col("n_chars") > 2000) / F.count("*") / 4).alias("p"))
    return rounded(paired.holm(p), "p", "adjusted")


@query()
def bootstrap_ci(spark, sf_dir):
    rows = _arms(spark, sf_dir)
    ids = rows.select("doc_id", (F.col("x") - F.col("y")).alias("d"))
    pos = F.row_number().over(W.partitionBy("_p").orderBy("doc_id"))
    # positions by ranges of ids: a range's offset is the number of rows before it
    parts = ids.withColumn("_p", F.floor(F.col("doc_id") / 100_000))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    differences = parts.withColumn("_i", pos).join(sizes, "_p").select((F.col("_before") + F.col("_i") - 1).alias("pos"), "d")
    return paired.interval(paired.bootstrap_sums(differences, 10_000, 20261002))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.975), 4) AS high, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, list_sort(list(n_chars))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS nearest_90 FROM documents GROUP BY lang")
def quantile_summary(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents")
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(n, F.lit(0.975)), 4).alias("high"), F.min(n).alias("least"), F.max(n).alias("most"))
    ranks = {"upper_median": F.floor(F.col("n") / 2), "nearest_90": F.floor(0.9 * (F.col("n") - 1) + 0.5)}
    return sums.join(stats.at_ranks(rows, "lang", "n_chars", ranks), "lang")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def digest_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
