"""What a session has found, changed and checked since its task began: windows with resets, not a fold over its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.session_log import worked_out, string_at

#: What a finding, a line of a test's outcome, an edit that worked, an editing tool and a test command look like: fixed values.
FINDING = r"(?i)(?:root cause\s*(?:is|:)|(?:bug|problem|issue|cause)\s+is\b|caused by\b|根因[是：:]|原因[是：:])"
OUTCOME = r"(?i)(?:\b\d+\s+(?:passed|failed|errors?)\b|^\s*(?:FAILED|ERROR)\b|测试.*(?:通过|失败))"
WORKED = r"(?i)(?:successfully|has been (?:updated|written)|success|已更新|已写入)"
EDITS = ("edit", "write", "apply_patch")
COMMAND = r"\b(?:pytest|npm\s+test|pnpm\s+test|node\s+--test|cargo\s+test|go\s+test)\b"
HEAD, FOOT = "<task_progress>\n", "\n</task_progress>"


def _clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…"))).otherwise(text)


def milestones(segments: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """(session, diagnosis, change, checks, text) of each session's segments (session, idx, kind, text, id, call_id, tool_error) after its anchor (session, idx).

    ``diagnosis`` is the first finding of the latest assistant's or trace's text that states one; ``change`` what the latest edit that worked touched
    and said. ``checks`` are the outcomes of test commands since that edit, which makes earlier ones void: the latest of each command,
    the last three of these. Results meet their calls by id. ``text`` puts them together within ``most`` characters; null without
    any evidence, empty if not even its frame fits.
    """
    task = segments.join(anchors.select("session", F.col("idx").alias("_anchor")), "session").where(F.col("idx") > F.col("_anchor"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(FINDING)))
    said = task.where("kind IN ('trace', 'assistant')").select("session", "idx", F.get(lines, F.lit(0)).alias("_line")).where("_line IS NOT NULL")
    findings = said.groupBy("session").agg(F.max_by(_clip(F.col("_line"), 480), "idx").alias("diagnosis"))

    calls = task.where("kind = 'toolCall'").groupBy("session", F.col("id").alias("call_id")).agg(F.max_by("text", "idx").alias("_call"))
    results = task.where("kind = 'toolResult' AND call_id IS NOT NULL").join(calls, ["session", "call_id"])
    form = r"^tool call: ([^\n]+)\n([\s\S]*)$"
    made = results.withColumn("_name", F.regexp_extract("_call", form, 1)).withColumn("_args", F.try_parse_json(F.regexp_extract("_call", form, 2))).where(F.startswith(F.schema_of_variant("_args"), F.lit("OBJECT")))
    file = F.coalesce(string_at(F.col("_args"), "$.file_path"), string_at(F.col("_args"), "$.path"), F.lit(""))
    wrong = F.coalesce("tool_error", F.lit(False))
    worked = F.col("_name").isin(*EDITS) & ~wrong & ((F.col("tool_error") == F.lit(False)).eqNullSafe(True) | F.regexp_like("text", F.lit(WORKED)))
    command = F.coalesce(string_at(F.col("_args"), "$.command"), F.lit(""))
    told = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(OUTCOME)))
    facts = worked_out(made.select("session", "idx", "text", file.alias("_file"), worked.alias("_edit"), command.alias("_command"), told.alias("_told"), wrong.alias("_wrong")))
    changes = facts.where("_edit").groupBy("session").agg(F.max_by(F.concat(_clip(F.col("_file"), 160), F.lit("\n"), _clip(F.col("text"), 200)), "idx").alias("change"), F.max("idx").alias("_reset"))

    tests = facts.where(F.regexp_like("_command", F.lit(COMMAND)) & (F.size("_told") > 0)).join(changes.select("session", "_reset"), "session", "left").where("_reset IS NULL OR idx >= _reset")
    two = _clip(F.array_join(F.slice("_told", F.greatest(F.size("_told") - 1, F.lit(1)), F.lit(2)), "\n"), 200)
    shown = F.concat(_clip(F.col("_command"), 140), F.lit("\n"), two, F.when(F.col("_wrong"), "\n[tool reported an error]").otherwise(""))
    latest = tests.groupBy("session", "_command").agg(F.max(F.struct("idx", shown.alias("shown"))).alias("_last"))
    place = F.row_number().over(W.partitionBy("session").orderBy(F.desc("_last.idx")))
    last = latest.withColumn("_place", place).where("_place <= 3").groupBy("session").agg(F.transform(F.sort_array(F.collect_list("_last")), lambda x: x["shown"]).alias("checks"))

    both = anchors.select("session").distinct().join(findings, "session", "left").join(changes.drop("_reset"), "session", "left").join(last, "session", "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))
    line = lambda head, c: F.when(F.length(c) > 0, F.concat(F.lit(head), c))
    parts = F.concat(F.array_compact(F.array(line("Finding (model statement):\n", F.col("diagnosis")), line("Latest write/edit result:\n", F.col("change")))), F.transform("checks", lambda t: F.concat(F.lit("Verification evidence:\n"), t)))
    room = most - len(HEAD) - len(FOOT)
    text = F.concat(F.lit(HEAD), _clip(F.array_join(parts, "\n\n"), room), F.lit(FOOT)) if room > 0 else F.lit("")
    return both.select("session", "diagnosis", "change", "checks", F.when(F.size(parts) > 0, text).alias("text"))
