"""Queries over session logs: each of ``events`` as a line of JSON as an agent's harness writes it, in the shapes that such logs mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import milestones, session_log
from weftline.operators.checkpoints import checkpointed
from weftline.plans.registry import EV, TOKENS, event_segments, query, table


def session_lines(spark, sf_dir) -> DataFrame:
    """(session, pos, value): clicks are calls, views results, purchases the assistant's, signups the user's; of errors some are broken lines, some
    lifecycle events, some blank. What they say comes from the event's ``props``."""
    props = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    ev = event_segments(spark, sf_dir).join(props, "event_id")
    order = W.partitionBy("session").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    clicks = F.when(F.col("event_type") == "click", F.col("event_id"))
    call = F.when(F.col("k") % 7 == 0, F.first(clicks, ignorenulls=True).over(order)).otherwise(F.last(clicks, ignorenulls=True).over(order))
    ev = ev.withColumn("call", call)
    k, n = F.col("k").cast("string"), F.col("idx").cast("string")
    edit = F.col("k") % 3 == 0
    arguments = F.when(edit, F.concat(F.lit('{"file_path":"f'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"command":"pytest t'), (F.col("k") % 4).cast("string"), F.lit('"}')))
    given = F.when(F.col("k") % 2 == 0, arguments).otherwise(F.concat(F.lit('"'), F.replace(arguments, F.lit('"'), F.lit('\\"')), F.lit('"')))
    head = lambda kind: F.concat(F.lit(f'{{"type":"{kind}","seq":'), n, F.lit(',"data":'))
    calls = F.concat(head("tool/call"), F.lit('{"turn":1,"callId":"c'), F.col("event_id").cast("string"), F.lit('","name":"'), F.when(edit, "edit").otherwise("bash"), F.lit('","arguments":'), given, F.lit("}}"))
    named = F.when(F.col("call").isNotNull(), F.concat(F.lit('"toolCallId":"c'), F.col("call").cast("string"), F.lit('",'))).otherwise("")
    said = F.concat(F.lit('[{"type":"text","text":"ran\\n'), k, F.when(F.col("k") % 4 == 0, " failed").otherwise(" passed"), F.lit('"},"raw"]'))
    results = F.concat(head("tool/result"), F.lit('{"message":{"role":"tool","id":"r'), F.col("event_id").cast("string"), F.lit('",'), named, F.lit('"isError":'), F.when(F.col("k") % 5 == 0, "true").otherwise("false"), F.lit(',"content":'), said, F.lit("}}}"))
    thought = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"type":"reasoning","text":"so\\nroot cause is f'), k, F.lit('"},'))).otherwise("")
    assistant = F.concat(head("assistant/message"), F.lit('{"turn":1,"message":{"role":"assistant","content":['), thought, F.lit('{"type":"text","text":"done '), k, F.lit('"},{"name":"n","type":"tool-call","id":"x"}]}}}'))
    role = F.when(F.col("k") % 10 == 0, "robot").otherwise("user")
    plain = F.when(F.col("k") % 3 == 0, F.concat(F.lit('"  plain '), k, F.lit('  "'))).when(F.col("k") % 3 == 1, F.concat(F.lit('[{"type":"text","text":"typed '), k, F.lit('"}]'))).otherwise('""')
    user = F.concat(head("user/message"), F.lit('{"role":"'), role, F.lit('","source":{"kind":"cli"},"content":'), plain, F.lit("}}"))
    broken = F.when(F.col("k") % 3 == 0, '{"type":"user/mess').when(F.col("k") % 3 == 1, F.concat(head("step/start"), F.lit('{"turn":1}}'))).otherwise("  ")
    kind = F.col("event_type")
    value = F.when(kind == "click", calls).when(kind == "view", results).when(kind == "purchase", assistant).when(kind == "signup", user).otherwise(broken)
    return ev.select("session", F.col("idx").alias("pos"), value.alias("value"))


def _segments(spark, sf_dir) -> DataFrame:
    return checkpointed(session_log.adapted(session_log.session_events(session_lines(spark, sf_dir))))


#: What the lines say, straight from the events.
LOG = f"""{EV}, k AS (SELECT ev.*, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev JOIN (SELECT event_id, props FROM events) USING (event_id)),
c AS (SELECT *, CASE WHEN k % 7 = 0 THEN first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w END AS call
  FROM k WINDOW w AS (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
log AS (SELECT session, idx AS pos, idx AS seq, event_type, k,
  CASE event_type WHEN 'click' THEN 'c' || event_id WHEN 'view' THEN 'r' || event_id ELSE 'm0' END AS id,
  CASE event_type WHEN 'click' THEN 'toolCall' WHEN 'view' THEN 'toolResult' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'trace' ELSE 'assistant' END ELSE CASE WHEN k % 10 = 0 THEN 'systemPinned' ELSE 'user' END END AS kind,
  CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'assistant' ELSE CASE WHEN k % 10 = 0 THEN 'robot' ELSE 'user' END END AS role,
  CASE event_type WHEN 'click' THEN 'tool call: ' || CASE WHEN k % 3 = 0 THEN 'edit' ELSE 'bash' END || chr(10) || CASE WHEN k % 3 = 0 THEN '{{"file_path":"f' || k || '"}}' ELSE '{{"command":"pytest t' || k % 4 || '"}}' END
    WHEN 'view' THEN 'ran' || chr(10) || k || CASE WHEN k % 4 = 0 THEN ' failed' ELSE ' passed' END || chr(10) || 'raw'
    WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'so' || chr(10) || 'root cause is f' || k || chr(10) ELSE '' END || 'done ' || k || chr(10) || '[tool-call] {{"id":"x","name":"n","type":"tool-call"}}'
    WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'plain ' || k WHEN 1 THEN 'typed ' || k ELSE '' END END AS text,
  CASE WHEN event_type = 'signup' THEN 'cli' END AS task_tag, CASE WHEN event_type = 'view' THEN 'c' || call END AS call_id, CASE WHEN event_type = 'view' THEN k % 5 = 0 END AS tool_error,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'bad line' WHEN event_type = 'error' AND k % 3 = 1 THEN 'lifecycle' WHEN event_type = 'signup' AND k % 3 = 2 THEN 'empty' WHEN event_type <> 'error' THEN 'segment' END AS outcome FROM c),
sg AS (SELECT * FROM log WHERE outcome = 'segment')"""


@query(f"WITH {LOG} SELECT session, pos, seq, id, kind, role, text, {TOKENS.format('text')} AS tokens, task_tag, call_id, tool_error FROM sg")
def session_segments(spark, sf_dir):
    return _segments(spark, sf_dir).where("outcome = 'segment'").select("session", "pos", "seq", "id", "kind", "role", "text", "tokens", "task_tag", "call_id", "tool_error")


@query(
    f"""WITH {LOG} SELECT session, count(*) AS lines, count(*) FILTER (outcome = 'segment') AS segments, count(*) FILTER (outcome = 'bad line') AS bad, count(*) FILTER (outcome = 'lifecycle') AS lifecycle, count(*) FILTER (outcome = 'empty') AS empty,
  count(*) FILTER (outcome = 'segment' AND role = 'robot') AS unknown_roles FROM log WHERE outcome IS NOT NULL GROUP BY session"""
)
def session_report(spark, sf_dir):
    return session_log.report(_segments(spark, sf_dir), "session")


@query(
    f"""WITH {LOG}, r AS (SELECT session, call_id, min(pos) AS result_pos FROM sg WHERE kind = 'toolResult' AND call_id IS NOT NULL GROUP BY ALL)
SELECT s.session, s.id AS call_id, s.pos AS call_pos, result_pos FROM sg s LEFT JOIN r ON r.session = s.session AND r.call_id = s.id WHERE kind = 'toolCall'
UNION ALL SELECT session, NULL, NULL, pos FROM sg WHERE kind = 'toolResult' AND call_id IS NULL"""
)
def calls_by_id(spark, sf_dir):
    """Calls with their first result, whatever is open between them."""
    return session_log.paired_calls(_segments(spark, sf_dir).where("outcome = 'segment'"))


@query(
    """WITH p AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN turn % 3 WHEN 'assistant' THEN 3 ELSE 4 END AS shape, trim(text) AS text FROM conversations WHERE length(trim(text)) > 0)
SELECT conv_id, turn, CASE WHEN shape = 4 THEN NULL WHEN shape = 3 THEN 'second' ELSE text END AS prompt FROM p"""
)
def system_prompts(spark, sf_dir):
    """Each turn wrapped one to three levels deep, as harnesses do; where two levels have a prompt, the outer one counts."""
    rows = table(spark, sf_dir, "conversations").where("length(trim(text)) > 0")
    record = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    said = F.trim("text")
    flat = F.to_json(record("system", said))
    once = F.to_json(F.struct(F.lit("e").alias("type"), record("developer", said).alias("message")))
    twice = F.to_json(F.struct(F.struct(record("system", said).alias("payload")).alias("data")))
    both = F.to_json(F.struct(F.struct(record("system", said).alias("message")).alias("message"), record("developer", F.lit("second")).alias("payload")))
    deep = F.to_json(F.struct(F.struct(F.struct(record("system", said).alias("data")).alias("data")).alias("data")))
    shape = F.when(F.col("role") == "user", F.col("turn") % 3).when(F.col("role") == "assistant", 3).otherwise(4)
    value = F.when(shape == 0, flat).when(shape == 1, once).when(shape == 2, twice).when(shape == 3, both).otherwise(deep)
    return rows.select("conv_id", "turn", session_log.system_prompt(F.try_parse_json(value)).alias("prompt"))


@query(
    f"""WITH {LOG}, anchor AS (SELECT session, min(pos) AS a FROM sg WHERE kind = 'user' GROUP BY session), task AS (SELECT sg.* FROM sg JOIN anchor ON anchor.session = sg.session WHERE pos > a),
find AS (SELECT session, arg_max('root cause is f' || k, pos) AS diagnosis FROM task WHERE kind = 'trace' GROUP BY session),
res AS (SELECT r.session, r.pos, r.text, r.tool_error, c.k AS ck FROM task r JOIN task c ON c.session = r.session AND c.id = r.call_id WHERE r.kind = 'toolResult'),
chg AS (SELECT session, arg_max('f' || ck || chr(10) || text, pos) AS change, max(pos) AS reset FROM res WHERE ck % 3 = 0 AND NOT tool_error GROUP BY session),
test AS (SELECT res.session, 'pytest t' || ck % 4 AS command, max(ROW(pos, 'pytest t' || ck % 4 || chr(10) || split_part(text, chr(10), 2) || CASE WHEN tool_error THEN chr(10) || '[tool reported an error]' ELSE '' END)) AS last
  FROM res LEFT JOIN chg ON chg.session = res.session WHERE ck % 3 <> 0 AND (reset IS NULL OR pos >= reset) GROUP BY ALL),
top AS (SELECT session, list(last[2] ORDER BY last[1]) AS checks FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY last[1] DESC) AS p FROM test) WHERE p <= 3 GROUP BY session),
j AS (SELECT anchor.session, diagnosis, change, coalesce(checks, []) AS checks FROM anchor LEFT JOIN find ON find.session = anchor.session LEFT JOIN chg ON chg.session = anchor.session LEFT JOIN top ON top.session = anchor.session),
p AS (SELECT *, array_to_string(list_concat(list_filter(['Finding (model statement):' || chr(10) || diagnosis, 'Latest write/edit result:' || chr(10) || change], lambda x: x IS NOT NULL), list_transform(checks, lambda x: 'Verification evidence:' || chr(10) || x)), chr(10) || chr(10)) AS t FROM j)
SELECT session, diagnosis, change, array_to_string(checks, '|') AS checks, CASE WHEN t <> '' THEN '<task_progress>' || chr(10) || CASE WHEN length(t) > 167 THEN left(t, 166) || '…' ELSE t END || chr(10) || '</task_progress>' END AS text FROM p"""
)
def task_milestones(spark, sf_dir):
    """What each session found, changed and checked since its first user's message, within 200 characters."""
    seg = _segments(spark, sf_dir).where("outcome = 'segment'").withColumn("idx", F.col("pos"))
    first = seg.where("kind = 'user'").groupBy("session").agg(F.min("idx").alias("idx"))
    return milestones.milestones(seg, first, 200).withColumn("checks", F.array_join("checks", "|"))
