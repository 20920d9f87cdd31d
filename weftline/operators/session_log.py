"""Session logs of JSON lines whose records have many shapes: read as VARIANT, turned into segments, and searched for their system prompt."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import estimate_tokens

#: Event types that carry conversation, roles and the kinds they become, part types that are reasoning, keys that wrap a record: fixed values.
CONTENT = ("user/message", "assistant/message", "tool/call", "tool/result")
ROLES = {"user": "user", "assistant": "assistant", "system": "systemPinned", "developer": "systemPinned", "tool": "toolResult"}
REASONING = ("reasoning", "thinking", "trace")
WRAPPERS = ("message", "data", "payload")
#: Characters of a part without text, and of a call's arguments, that are shown.
SHOWN = 2000


def session_events(lines: DataFrame) -> DataFrame:
    """(session, pos, event, fault) of (session, pos, value): each line that isn't blank as a VARIANT, or with a fault and no event."""
    rows = lines.where(F.trim("value") != "").select("session", "pos", F.try_parse_json("value").alias("event"))
    return rows.withColumn("fault", F.when(F.col("event").isNull(), "no JSON"))


def at(record: Column, path: str) -> Column:
    """What is at a path, as a VARIANT; null where there is nothing. JSON's null is a value."""
    return F.try_variant_get(record, path, "variant")


def worked_out(df: DataFrame) -> DataFrame:
    """The same rows; what their columns are is worked out once here, not again wherever a later step names them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def string_at(record: Column, path: str) -> Column:
    """The string at a path; null for what is no string."""
    found = at(record, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(record, path, "string"))


def _clipped(text: Column) -> Column:
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.lit("…"))).otherwise(text)


def part_text(part: Column) -> Column:
    """A string itself, an object's text, or else its type and JSON (keys in order), clipped; nothing for other values."""
    kind = F.schema_of_variant(part)
    name = string_at(part, "$.type")
    shown = F.concat(F.lit("["), F.when(F.length(name) > 0, name).otherwise("unknown-part"), F.lit("] "), _clipped(F.to_json(part)))
    return F.when(kind == "STRING", part.cast("string")).when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(string_at(part, "$.text"), shown)).otherwise("")


def _parts(record: Column) -> Column:
    """A record's content as an array: itself, or its one value, or empty."""
    found = at(record, "$.content")
    none = F.array().cast("array<variant>")
    return F.when(found.isNull(), none).otherwise(F.coalesce(F.try_variant_get(record, "$.content", "array<variant>"), F.array(found)))


def _joined(parts: Column) -> Column:
    return F.regexp_replace(F.array_join(F.filter(F.transform(parts, part_text), lambda t: t != ""), "\n"), r"^\s+|\s+$", "")


def adapted(events: DataFrame) -> DataFrame:
    """(session, pos, seq, type, outcome, id, kind, role, text, tokens, task_tag, call_id, tool_error): each event as a segment or with the reason why it is none.

    ``outcome`` is segment, bad line, lifecycle (a type that carries no conversation, or no message in it) or empty. A message is in ``data.message``, or is
    ``data`` if that has content; a call is rendered as its name and arguments. A reasoning part makes an assistant's message a
    trace; unknown roles are pinned. Only results have a ``call_id`` (of their call, if they name one) and ``tool_error``; a call's own id is ``id``.
    """
    e = F.col("event")
    kind = F.coalesce(string_at(e, "$.type"), F.lit(""))
    content = (kind == "") | kind.isin(*CONTENT)
    data = at(e, "$.data")
    whole = F.coalesce(at(data, "$.message"), F.when(at(data, "$.content").isNotNull(), data))
    number = F.try_variant_get(e, "$.seq", "double")
    rows = worked_out(events.select("session", "pos", "event", "fault", F.coalesce(F.when(~F.isnan(number), number).cast("long"), F.col("pos")).alias("seq"), kind.alias("type"), F.when(content, whole).alias("_m"), F.when(content, data).alias("_d")))
    m = F.col("_m")
    rows = worked_out(rows.withColumn("_parts", F.when(F.startswith(F.schema_of_variant(m), F.lit("OBJECT")), _parts(m))).withColumn("_role", F.coalesce(string_at(m, "$.role"), F.lit(""))))
    first = lambda name: F.coalesce(F.when(F.length(string_at(F.col("_d"), f"$.{name}")) > 0, string_at(F.col("_d"), f"$.{name}")), F.when(at(F.col("_d"), f"$.{name}").isNull() & (F.length(string_at(e, f"$.{name}")) > 0), string_at(e, f"$.{name}")))
    given = F.coalesce(at(F.col("_d"), "$.arguments"), at(e, "$.arguments"))
    arguments = F.when(F.schema_of_variant(given) == "STRING", given.cast("string")).otherwise(F.coalesce(F.to_json(given), F.lit("null")))
    call = (F.col("type") == "tool/call") & m.isNull()
    rows = rows.withColumn("_call", F.when(call, F.concat(F.lit("tool call: "), F.coalesce(first("name"), F.lit("(unnamed)")), F.lit("\n"), _clipped(arguments))))
    rows = worked_out(rows.withColumn("text", F.coalesce("_call", F.when(F.col("_parts").isNotNull(), _joined(F.col("_parts"))))))
    kinds = F.lit("systemPinned")
    for role, name in ROLES.items():
        kinds = F.when(F.col("_role") == role, name).otherwise(kinds)
    thinks = F.exists("_parts", lambda p: F.coalesce(string_at(p, "$.type").isin(*REASONING), F.lit(False)))
    rows = rows.withColumn("kind", F.when(call, "toolCall").when(thinks & (F.col("_role") == "assistant"), "trace").otherwise(kinds))
    outcome = F.when(F.col("fault").isNotNull(), "bad line").when(F.col("text").isNull(), "lifecycle").when(F.col("text") == "", "empty").otherwise("segment")
    own = F.when(F.length(string_at(m, "$.id")) > 0, string_at(m, "$.id"))
    name = F.when(call, F.coalesce(first("callId"), F.concat(F.lit("toolcall-"), F.col("seq").cast("string")))).otherwise(F.coalesce(own, F.lit("m0")))
    result = F.col("kind") == "toolResult"
    kept = lambda c: F.when(outcome == "segment", c)
    return worked_out(rows.select(
        "session", "pos", "seq", "type", outcome.alias("outcome"), kept(name).alias("id"), kept(F.col("kind")).alias("kind"), kept(F.when(call, "tool").otherwise(F.col("_role"))).alias("role"), kept(F.col("text")).alias("text"),
        kept(estimate_tokens(F.col("text"))).alias("tokens"), kept(string_at(m, "$.source.kind")).alias("task_tag"), kept(F.when(result, string_at(m, "$.toolCallId"))).alias("call_id"), kept(F.when(result & (F.schema_of_variant(at(m, "$.isError")) == "BOOLEAN"), F.try_variant_get(m, "$.isError", "boolean"))).alias("tool_error"),
    ))


def report(adapted_rows: DataFrame, *by: str) -> DataFrame:
    """(by..., lines, segments, bad, lifecycle, empty, unknown_roles): what became of the lines; sums of it are reports of larger groups."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    strange = F.count_if((F.col("outcome") == "segment") & ~F.col("role").isin(*ROLES))
    return adapted_rows.groupBy(*by).agg(F.count("*").alias("lines"), is_("segment").alias("segments"), is_("bad line").alias("bad"), is_("lifecycle").alias("lifecycle"), is_("empty").alias("empty"), strange.alias("unknown_roles"))


def prompt_paths(levels: int = 3) -> list[str]:
    """Where a system prompt is looked for: a record, what it wraps, and what that wraps, in this order."""
    return ["$" + "".join(f".{key}" for key in keys) for level in range(levels) for keys in product(WRAPPERS, repeat=level)]


def system_prompt(event: Column) -> Column:
    """The text of the first record of role system or developer that has any, level by level; null if none has."""

    def text(path: str) -> Column:
        record = event if path == "$" else at(event, path)
        parts = F.try_variant_get(record, "$.content", "array<variant>")
        said = _joined(F.coalesce(parts, F.array().cast("array<variant>")))
        return F.when(string_at(record, "$.role").isin("system", "developer") & (said != ""), said)

    return F.coalesce(*[text(path) for path in prompt_paths()])


def paired_calls(segments: DataFrame) -> DataFrame:
    """(session, call_id, call_pos, result_pos): calls and results by the id they share, whatever is between them.

    Of several calls of one id the last before the result counts, of several results of a call the first. A call without a result has no ``result_pos``, a
    result without a call no ``call_pos``.
    """
    both = segments.where("kind = 'toolCall' OR kind = 'toolResult'").select("session", F.coalesce(F.when(F.col("kind") == "toolCall", F.col("id")), F.col("call_id")).alias("call_id"), "pos", (F.col("kind") == "toolCall").alias("_call"))
    named = both.where("call_id IS NOT NULL")
    by_id = W.partitionBy("session", "call_id").orderBy("pos")
    opened = named.withColumn("call_pos", F.last(F.when(F.col("_call"), F.col("pos")), ignorenulls=True).over(by_id.rowsBetween(W.unboundedPreceding, 0)))
    results = opened.where("NOT _call").groupBy("session", "call_id", "call_pos").agg(F.min("pos").alias("result_pos"))
    calls = named.where("_call").select("session", "call_id", F.col("pos").alias("call_pos"))
    found = calls.join(results.where("call_pos IS NOT NULL"), ["session", "call_id", "call_pos"], "left")
    lost = results.where("call_pos IS NULL").unionByName(both.where("call_id IS NULL AND NOT _call").select("session", "call_id", F.lit(None).cast("long").alias("call_pos"), F.col("pos").alias("result_pos")))
    return found.unionByName(lost)
