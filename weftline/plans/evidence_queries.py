"""Queries over what runs leave behind: ``events`` of a user as a run, each event as one of its records, in the forms that such files have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import evidence, pairs, planning
from weftline.operators.checkpoints import checkpointed
from weftline.plans.registry import EV, HIGH, TOPIC, event_segments, query, rounded, table

INJECTED = "given-"


def _events(spark, sf_dir) -> DataFrame:
    """Events with the number ``k`` of their ``props``, and the window ``w`` that they name."""
    props = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = 8 * (1 + F.col("session") % 3) + F.when(F.col("session") % 4 == 0, F.col("k") % 2 * 4).otherwise(0)
    return event_segments(spark, sf_dir).join(props, "event_id").withColumn("w", F.when(F.col("k") % 11 == 0, F.lit(0)).otherwise(w))


KEV = f"""{EV}, kev AS (SELECT ev.*, k, CASE WHEN k % 11 = 0 THEN 0 ELSE 8 * (1 + session % 3) + CASE WHEN session % 4 = 0 THEN k % 2 * 4 ELSE 0 END END AS w
  FROM ev JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) USING (event_id))"""


def _json(*parts) -> F.Column:
    """Texts and columns, one after the other; a null column makes the whole null."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, records, edges, calls): signups are wiring records, purchases tuning records, clicks edges, views calls of the lane; some runs lack some of them."""
    ev = _events(spark, sf_dir).withColumnRenamed("session", "cell").withColumnRenamed("idx", "pos")
    c, k, w = F.col("cell"), F.col("k"), F.col("w")
    kind = F.col("event_type")
    lane = (
        F.when(c % 5 == 0, ',"s1":"none"').when(c % 5 == 1, ',"s1":{"provider":"local","mode":"http"}').when(c % 5 == 2, ',"s1":{"provider":"x","mode":"none"}')
        .when((c % 5 == 3) & (k % 2 == 0), "").when(c % 5 == 3, ',"s1":"none","configuredProvider":"local","conflicts":["a","b"]').otherwise(',"s1":7')
    )
    wiring = _json('{"kind":"wiring","recall":{"w":', w, "}", lane, "}")
    tuning = _json('{"kind":"tuning-file","effective":{"window":"', w, '"', F.when(c % 6 == 2, "").when(k % 2 == 0, ',"provider":"none"').otherwise(',"provider":"local"'), "}}")
    text = F.when((kind == "signup") & (c % 6 != 0), wiring).when((kind == "purchase") & (c % 6 > 1), tuning)
    records = ev.select("cell", "pos", F.try_parse_json(text).alias("record")).where("record IS NOT NULL")
    edges = ev.where((kind == "click") & (c % 7 != 0)).select("cell", F.when(k % 2 == 0, _json("window:", w, ";s1")).otherwise("fallback").alias("provenance"))
    calls = ev.where((kind == "view") & (c % 12 != 0)).select("cell", "pos", F.when(k % 3 != 0, _json("p", k % 2)).alias("provider"))
    return ev.select("cell").distinct(), records, edges, calls


WINDOWS = """said AS (SELECT session AS cell, 0 AS r, idx AS p, CASE event_type WHEN 'signup' THEN 'wiring' ELSE 'tuning-file' END AS source, w FROM kev WHERE event_type = 'signup' AND session % 6 <> 0 OR event_type = 'purchase' AND session % 6 > 1
  UNION ALL SELECT session, 1, 0, 'edges', w FROM kev WHERE event_type = 'click' AND session % 7 <> 0 AND k % 2 = 0),
named AS (SELECT cell, list_sort(list(DISTINCT w)) AS ws, arg_min(source, r * 1000000000000 + p) AS source FROM said WHERE w > 0 GROUP BY cell),
wins AS (SELECT c.cell, CASE WHEN len(ws) = 1 THEN ws[1] END AS w, CASE WHEN len(ws) = 1 THEN source END AS source, coalesce(array_to_string(ws, ','), '') AS candidates, CASE WHEN ws IS NULL THEN 'no window recorded' WHEN len(ws) > 1 THEN 'records disagree' END AS reason
  FROM (SELECT DISTINCT session AS cell FROM ev) c LEFT JOIN named ON named.cell = c.cell)"""
LANES = """wired AS (SELECT session AS cell, min(idx) AS p, arg_min(k, idx) AS k FROM kev WHERE event_type = 'signup' AND session % 6 <> 0 AND NOT (session % 5 = 3 AND k % 2 = 0) GROUP BY session),
tuned AS (SELECT session AS cell, min(idx) AS p, arg_min(CASE WHEN k % 2 = 0 THEN 'none' ELSE 'local' END, idx) AS provider FROM kev WHERE event_type = 'purchase' AND session % 6 > 2 GROUP BY session),
called AS (SELECT session AS cell, arg_min('p' || k % 2, idx) FILTER (k % 3 <> 0) AS provider, count(*) AS n FROM kev WHERE event_type = 'view' AND session % 12 <> 0 GROUP BY session),
lanes AS (SELECT c.cell, coalesce(called.n, 0) AS calls,
  CASE WHEN wired.p IS NOT NULL THEN CASE c.cell % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'present' WHEN 2 THEN 'none' WHEN 3 THEN 'demoted' ELSE CASE WHEN tuned.p < wired.p THEN CASE WHEN tuned.provider = 'none' THEN 'none' ELSE 'present' END ELSE 'unknown' END END
    WHEN tuned.p IS NOT NULL THEN CASE WHEN tuned.provider = 'none' THEN 'none' ELSE 'present' END WHEN called.n IS NOT NULL THEN 'present' ELSE 'unknown' END AS state,
  CASE WHEN wired.p IS NOT NULL THEN CASE c.cell % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'local' WHEN 2 THEN 'x' WHEN 3 THEN 'none' ELSE CASE WHEN tuned.p < wired.p THEN tuned.provider END END WHEN tuned.p IS NOT NULL THEN tuned.provider ELSE called.provider END AS provider,
  CASE WHEN wired.p IS NOT NULL AND c.cell % 5 = 3 THEN 'local' END AS configured, CASE WHEN wired.p IS NOT NULL AND c.cell % 5 = 3 THEN 2 END AS conflicts,
  CASE WHEN wired.p IS NOT NULL THEN 'wiring' WHEN tuned.p IS NOT NULL THEN 'tuning' WHEN called.n IS NOT NULL THEN 'calls' ELSE 'silence' END AS source
  FROM (SELECT DISTINCT session AS cell FROM ev) c LEFT JOIN wired ON wired.cell = c.cell LEFT JOIN tuned ON tuned.cell = c.cell LEFT JOIN called ON called.cell = c.cell)"""


@query(f'WITH {KEV}, {WINDOWS} SELECT cell, w AS "window", source, candidates, reason FROM wins')
def window_evidence(spark, sf_dir):
    cells, records, edges, _ = _run(spark, sf_dir)
    return evidence.window_evidence(cells, records, edges).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(f"WITH {KEV}, {LANES} SELECT cell, state, provider, configured, CAST(conflicts AS BIGINT) AS conflicts, source FROM lanes")
def lane_states(spark, sf_dir):
    cells, records, _, calls = _run(spark, sf_dir)
    return evidence.lane_state(cells, records, calls)


@query(
    f"""WITH {KEV}, {WINDOWS}, {LANES}, {TOPIC},
shape AS (SELECT session AS cell, count(*) AS n, coalesce(max(idx) FILTER (event_type = 'purchase') + 1, 0) AS cut, coalesce(max(idx) FILTER (event_type = 'signup') + 1, 0) AS old FROM ev GROUP BY session),
graph AS (SELECT shape.cell, CASE WHEN shape.cell % 8 <> 1 THEN n END AS n, cut, n AS len, CASE WHEN shape.cell % 2 = 0 THEN n ELSE old END AS seen, CASE WHEN shape.cell % 11 <> 0 THEN CASE WHEN shape.cell % 9 = 4 THEN n ELSE cut END END AS cursor FROM shape),
scores AS (SELECT sc.session AS cell, count(*) AS settled, count(*) FILTER (w > 0.3) AS judged FROM sc JOIN graph ON graph.cell = sc.session WHERE to_idx < cut GROUP BY ALL),
put AS (SELECT g.cell, g.n, g.cursor, l.state, l.calls, w.w, w.reason, CASE WHEN g.cell % 10 <> 3 THEN coalesce(s.settled, 0) END AS settled, coalesce(s.settled, 0) AS scored, coalesce(s.judged, 0) AS judged,
  CASE WHEN g.cell % 10 <> 7 THEN coalesce((SELECT CAST(sum(least(i, coalesce(w.w, 16))) AS BIGINT) FROM range(0, g.seen) t(i) WHERE i >= g.cut), 0) END AS deferred
  FROM graph g JOIN wins w ON w.cell = g.cell JOIN lanes l ON l.cell = g.cell LEFT JOIN scores s ON s.cell = g.cell),
off AS (SELECT put.*, (SELECT CAST(sum(least(i, w)) AS BIGINT) FROM range(1, n) t(i)) AS sums, CASE WHEN n IS NULL THEN 'no order recorded' WHEN w IS NULL THEN reason END AS why, CASE WHEN state = 'demoted' THEN 'demoted' WHEN state = 'none' OR state = 'unknown' AND calls = 0 THEN 'absent' ELSE 'present' END AS lane FROM put),
o2 AS (SELECT *, CASE WHEN why IS NULL THEN coalesce(sums, 0) END AS offered FROM off),
k AS (SELECT cell, max(CASE WHEN l = deferred THEN i END) AS k FROM (SELECT o2.cell, deferred, i, sum(least(i, w)) OVER (PARTITION BY o2.cell ORDER BY i DESC) AS l FROM o2, range(1, (SELECT max(len) FROM graph)) t(i) WHERE i < n) GROUP BY cell)
SELECT o2.cell, lane, offered, CASE WHEN lane <> 'present' THEN 'lane ' || lane WHEN settled IS NULL THEN 'no scores recorded' WHEN why IS NOT NULL THEN why WHEN offered = 0 THEN 'nothing offered' END AS floor_reason,
  CASE WHEN deferred IS NULL THEN 'deferral not recorded' WHEN why IS NOT NULL THEN why WHEN offered = 0 THEN 'nothing offered' END AS deferred_reason,
  CASE WHEN deferred IS NULL THEN 'deferral not recorded' WHEN deferred = 0 THEN 'nothing deferred' WHEN why IS NOT NULL THEN why WHEN cursor IS NULL THEN 'cursor not recorded' WHEN cursor >= n THEN 'all recovered' WHEN k IS NULL THEN 'no index fits' END AS refusal_reason,
  CASE WHEN lane = 'present' AND settled IS NOT NULL AND why IS NULL AND offered > 0 THEN round(settled / offered, 6) END AS floor, CASE WHEN deferred IS NOT NULL AND why IS NULL AND offered > 0 THEN round(deferred / offered, 6) END AS deferred_share,
  CASE WHEN deferred > 0 AND why IS NULL AND cursor < n THEN k END AS first_refused, CASE WHEN scored > 0 THEN round(judged / scored, 6) END AS judged_share
FROM o2 LEFT JOIN k ON k.cell = o2.cell"""
)
def run_coverage(spark, sf_dir):
    """A run scores up to its last purchase and defers the rest, counted at its end or, in odd runs, when its last signup came."""
    cells, records, edges, calls = (checkpointed(df) for df in _run(spark, sf_dir))
    c, n = F.col("cell"), F.col("segments")
    seg = event_segments(spark, sf_dir)
    after = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("idx"))) + 1, F.lit(0))
    shape = seg.groupBy(F.col("session").alias("cell")).agg(F.count("*").alias("segments"), after("purchase").alias("cut"), after("signup").alias("old"))
    sc = pairs.topic_scores(seg).withColumnRenamed("session", "cell").join(shape.select("cell", "cut"), "cell").where("to_idx < cut")
    rows = sc.select("cell", F.col("from_idx").alias("from"), F.col("to_idx").alias("to"), "source", F.col("to_idx").alias("pos"), (F.col("w") > 0.3).alias("_j"))
    work = rows.groupBy("cell").agg(F.count("*").alias("scored"), F.count_if("_j").alias("judged"))
    lane = evidence.lane_state(cells, records, calls).select("cell", "state").join(calls.groupBy("cell").agg(F.count("*").alias("calls")), "cell", "left")
    windows = evidence.window_evidence(cells, records, edges).select("cell", "window", F.col("reason").alias("window_reason"))
    met = shape.join(lane, "cell").join(windows, "cell").join(evidence.settled_by(rows).select("cell", "settled"), "cell", "left").join(work, "cell", "left").fillna(0, ["calls", "settled", "scored", "judged"])
    seen, w = F.when(c % 2 == 0, n).otherwise(F.col("old")), F.coalesce("window", F.lit(16))
    tail = F.greatest(evidence.offered_pairs(seen, w) - evidence.offered_pairs(F.col("cut"), w), F.lit(0))
    graph = met.withColumns({"deferred": F.when(c % 10 != 7, tail), "settled": F.when(c % 10 != 3, F.col("settled")), "cursor": F.when(c % 11 != 0, F.when(c % 9 == 4, n).otherwise(F.col("cut"))), "segments": F.when(c % 8 != 1, n)})
    out = evidence.coverage(graph).select("cell", "lane", "offered", "floor_reason", "deferred_reason", "refusal_reason", "floor", "deferred_share", "first_refused", "judged_share")
    return rounded(out, "floor", "deferred_share", "judged_share")


@query(
    f"""WITH {KEV} SELECT event_id AS run, k % 7 > 4 AS present, CASE k % 7 WHEN 0 THEN 'no manifest' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no block' WHEN 3 THEN 'no version' WHEN 4 THEN 'no version' END AS reason,
CASE WHEN k % 7 > 4 THEN 'v' || k END AS version, CASE WHEN k % 7 = 5 THEN 'bin' || k % 3 END AS executable, CASE WHEN k % 7 = 5 THEN '' END AS command, CASE WHEN k % 7 = 6 THEN 'm' || idx END AS model FROM kev"""
)
def run_identities(spark, sf_dir):
    k = F.col("k")
    text = (
        F.when(k % 7 == 1, '{"_host":').when(k % 7 == 2, '{"other":1,"_host":"x"}').when(k % 7 == 3, '{"_host":[1]}').when(k % 7 == 4, '{"_host":{"version":""}}')
        .when(k % 7 == 5, _json('{"_host":{"version":"v', k, '","executable":"bin', k % 3, '","command":"","model":"none"}}'))
        .when(k % 7 == 6, _json('{"_host":{"version":"v', k, '","executable":"","command":5,"model":{"model":"m', F.col("idx"), '"}}}'))
    )
    return evidence.run_identity(_events(spark, sf_dir).select(F.col("event_id").alias("run"), text.alias("text"))).drop("probed_at", "provider")


def _stores(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stores, events, snapshots): users in tens are a cell's stores; purchases begin turns in some of them, signups leave snapshots."""
    ev = _events(spark, sf_dir).select(F.floor(F.col("session") / 10).alias("cell"), _json("s", F.col("session")).alias("path"), "session", "event_id", "event_type", "k")
    begun = (F.col("event_type") == "purchase") & (F.col("session") % 3 == 0) & (F.col("cell") % 4 != 0)
    events = ev.select("cell", "path", F.when(begun, "turn/start").otherwise("step/start").alias("type"))
    snapshots = ev.where("event_type = 'signup' AND k % 10 = 0").select("cell", _json("g", F.col("event_id")).alias("path"), F.col("path").alias("session"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 7).alias("judged"))
    return ev.groupBy("cell", "path").agg(F.count("*").alias("bytes")), events, snapshots


STORES = f"""{KEV}, st AS (SELECT session // 10 AS cell, 's' || session AS path, count(*) AS bytes, count(*) FILTER (event_type = 'purchase' AND session % 3 = 0 AND (session // 10) % 4 <> 0) AS turns FROM kev GROUP BY session),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY turns DESC, bytes DESC, path) AS r FROM st)"""


@query(f"WITH {STORES} SELECT cell, path, turns, CASE WHEN r = 1 AND turns > 0 THEN 'primary' WHEN r = 1 THEN 'never ran' WHEN turns > 0 THEN 'ignored' ELSE 'stub' END AS role FROM ranked")
def store_roles(spark, sf_dir):
    stores, events, _ = _stores(spark, sf_dir)
    return evidence.store_roles(stores, events)


@query(
    f"""WITH {STORES}, sn AS (SELECT session // 10 AS cell, 'g' || event_id AS path, 's' || session AS session, CASE WHEN event_id % 5 > 0 THEN event_id % 7 ELSE 0 END AS judged FROM kev WHERE event_type = 'signup' AND k % 10 = 0),
m AS (SELECT r.cell, arg_min(sn.path, ROW(-judged, sn.path)) FILTER (sn.session = r.path) AS path, count(*) FILTER (sn.session = r.path) AS matches, count(sn.path) AS found FROM ranked r LEFT JOIN sn ON sn.cell = r.cell WHERE r = 1 GROUP BY r.cell)
SELECT *, CASE WHEN found = 0 THEN 'no snapshots' WHEN matches = 0 THEN 'other sessions' WHEN matches > 1 THEN 'several' END AS reason FROM m"""
)
def chosen_snapshots(spark, sf_dir):
    stores, events, snapshots = _stores(spark, sf_dir)
    first = evidence.store_roles(stores, events).where("role IN ('primary', 'never ran')").select("cell", F.col("path").alias("session"))
    return evidence.chosen_snapshots(first, snapshots)


@query(
    f"""WITH {KEV} SELECT event_id, round(CASE k % 6 WHEN 0 THEN greatest(0, least(1, (k - 40) / 20)) WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 5 THEN k / (k + 1) END, 6) AS w FROM kev"""
)
def answered_weights(spark, sf_dir):
    """What the answers to each event's question weigh: numbers out of bounds, distributions that are not normalised, answers that say nothing."""
    k = F.col("k")
    text = (
        F.when(k % 6 == 0, _json('{"noul":', (k - 40) / 20, "}")).when(k % 6 == 1, '{"noul":"0.5","probabilities":{"true":2,"false":6}}').when(k % 6 == 2, '{"probabilities":{"yes":0,"no":-1}}')
        .when(k % 6 == 3, '{"probabilities":{"a":1,"true":"1"}}').when(k % 6 == 4, '{"probabilities":[]}').otherwise(_json('{"noul":null,"probabilities":{"yes":', k, ',"no":1,"x":-3}}'))
    )
    return rounded(_events(spark, sf_dir).select("event_id", evidence.answered_weight(F.try_parse_json(text)).alias("w")), "w")


@query(f"WITH {EV}, {TOPIC} SELECT sc.session, to_idx AS anchor, from_idx AS idx FROM sc JOIN ev ON ev.session = sc.session AND ev.idx = to_idx AND ev.event_type = 'click' WHERE w < {HIGH}")
def explicit_rejections(spark, sf_dir):
    """What the model's scores keep from each click; the same pairs as local scores reject nothing."""
    seg = event_segments(spark, sf_dir)
    scores = pairs.topic_scores(seg)
    both = scores.select("session", "from_idx", "to_idx", "w", "source").unionByName(scores.select("session", "from_idx", "to_idx", F.lit(0.0).alias("w"), F.lit("lexical").alias("source")))
    return evidence.rejections(seg, both, seg.where("event_type = 'click'").select("session", F.col("idx").alias("anchor")), HIGH)


@query(
    f"""WITH {KEV}, c AS (SELECT session AS run, count(*) FILTER (event_type <> 'click') AS lines, count(*) FILTER (event_type = 'click') AS control, count(*) FILTER (event_type = 'purchase') AS blocks, count(*) FILTER (event_type = 'purchase' AND session % 5 = 0 AND k % 4 = 0) AS authored,
  count(*) FILTER (event_type = 'error' AND session % 7 = 0) AS leaked, count(*) FILTER (event_type = 'signup' AND session % 3 = 0) AS odd, count(*) FILTER (event_type = 'click' AND k % 2 = 0) AS calls FROM kev GROUP BY session)
SELECT run, 'provenance' AS invariant, leaked + odd = 0 AS holds, leaked + odd AS found, 0::BIGINT AS wanted FROM c
UNION ALL SELECT run, 'authorship', authored = 0, authored, 0 FROM c
UNION ALL SELECT run, 'ingestion', run % 4 > 0 AND run % 11 > 0, blocks, CASE WHEN run % 4 > 0 THEN blocks + CAST(run % 11 = 0 AS BIGINT) END FROM c
UNION ALL SELECT run, 'evidence', run % 6 > 0, lines + control, lines + control FROM c
UNION ALL SELECT run, 'lane', calls > 0 AND leaked = 0 AND run % 9 <> 1, calls, CASE WHEN run % 9 = 1 THEN calls + 1 WHEN run % 9 = 2 THEN calls END FROM c"""
)
def run_invariants(spark, sf_dir):
    """Clicks are a run's control stream, the others its session: purchases as delivered blocks, some with headings of their own, errors that leak in some runs."""
    ev = checkpointed(_events(spark, sf_dir).withColumnRenamed("session", "run"))
    r, k, kind = F.col("run"), F.col("k"), F.col("event_type")
    text = F.when((r % 5 == 0) & (k % 4 == 0), "## what you should do\nplease").otherwise(_json("## earlier user turn, quoted verbatim · m", k, "\nsaid\r\n\r\n of # it"))
    given = kind == "purchase"
    session = ev.where(kind != "click").select(
        "run", F.when(given, _json(INJECTED, F.col("event_id"))).otherwise(_json("m", F.col("event_id"))).alias("id"), F.when((kind == "error") & (r % 7 == 0), "s1_call").otherwise("user/message").alias("type"),
        F.when((kind == "signup") & (r % 3 == 0), "odd").otherwise("user").alias("kind"), F.when(given, text).otherwise("# not given").alias("text")
    )
    control = ev.where(kind == "click").select("run", F.when(k % 2 == 0, "s1_call").otherwise("llm_call").alias("type"))
    n = ev.groupBy("run").agg(F.count_if(kind != "click").alias("l"), F.count_if(kind == "click").alias("c"), F.count_if(given).alias("b"), F.count_if((kind == "click") & (k % 2 == 0)).alias("s"))
    moved = (r % 6 == 0).cast("long")
    runs = n.select("run", F.when(r % 4 > 0, F.col("b") + (r % 11 == 0).cast("long")).alias("dropped"), (F.col("l") + moved).alias("session_lines"), (F.col("c") - moved).alias("control_lines"), F.when(r % 9 == 1, F.col("s") + 1).when(r % 9 == 2, F.col("s")).alias("lane_calls"))
    return evidence.invariants(runs, session, control, INJECTED)


# ---- plans and to-dos


@query(
    r"""WITH d AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 > 0 THEN '- ' || replace(text, chr(10), chr(10) || ' 2) ') ELSE replace(text, chr(10), chr(10) || '2)') END, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
s AS (SELECT doc_id, i, trim(regexp_extract(line, '^\s*(?:\d+[.)]|[-*+])\s+(\S.*)$', 1)) AS t FROM l WHERE regexp_matches(line, '^\s*(?:\d+[.)]|[-*+])\s+(\S.*)$')), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS step FROM s)
SELECT doc_id, step, 'p' || step AS id, CASE WHEN length(t) > 400 THEN left(t, 400) || '...' ELSE t END AS summary FROM r WHERE step <= 3"""
)
def stated_plans(spark, sf_dir):
    """The first three steps of each document with its lines as a list (the limit is what a plan may hold); in every third the marks are not those of a list."""
    listed = F.when(F.col("doc_id") % 3 > 0, _json("- ", F.replace("text", F.lit("\n"), F.lit("\n 2) ")))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n2)")))
    return planning.stated_plans(table(spark, sf_dir, "documents").select("doc_id", listed.alias("text")), "doc_id")


@query(
    f"""WITH {KEV}, i AS (SELECT session, event_id, k, unnest([1, 2, 3, 4, 5, 6]) AS j FROM kev WHERE event_type = 'purchase'),
t AS (SELECT *, CASE j WHEN 1 THEN 'look at ' || k WHEN 2 THEN 'wait' WHEN 3 THEN NULL WHEN 4 THEN '  ' ELSE 'then ' || j END AS content, CASE WHEN j = 2 AND k % 3 = 0 THEN 'dropped' WHEN (k + j) % 3 = 0 THEN 'completed' WHEN (k + j) % 3 = 1 THEN 'pending' ELSE 'in_progress' END AS status FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY j) AS step FROM t WHERE content IS NOT NULL AND trim(content) <> '' AND status NOT IN ('dropped', 'completed'))
SELECT session, event_id, step, 'p' || step AS id, trim(content) AS summary FROM r WHERE step <= 3"""
)
def todos_open(spark, sf_dir):
    """The open steps of to-do lists that purchases log; a list has items of other shapes and states too."""
    k = F.col("k")
    state = lambda j: F.when((k + j) % 3 == 0, "completed").when((k + j) % 3 == 1, "pending").otherwise("in_progress")
    item = lambda text, status: _json('{"content":', text, ',"status":"', status, '"}')
    says = [_json('"look at ', k, '"'), F.lit('"wait"'), F.lit("5"), F.lit('"  "'), F.lit('"then 5"'), F.lit('" then 6 "')]
    items = [item(s, F.when(k % 3 == 0, "dropped").otherwise(state(2)) if j == 2 else state(j)) for j, s in enumerate(says, 1)]
    text = _json(F.when(F.col("event_type") == "purchase", '{"type":"todo/write","data":{"todos":["x",').otherwise('{"type":"todo/read","data":{"todos":['), F.concat_ws(",", *items), "]}}")
    lists = planning.todos(_events(spark, sf_dir).select("session", "event_id", F.try_parse_json(text).alias("event")), "session", "event_id")
    return planning.open_todos(lists, "session", "event_id")
