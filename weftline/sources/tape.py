"""Tapes: one JSON object a step, each with the whole history of messages so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import estimate_tokens

PART = "STRUCT<type: STRING, text: STRING>"
MESSAGE = f"STRUCT<id: STRING, role: STRING, content: ARRAY<{PART}>, toolCallId: STRING, isError: BOOLEAN>"
STEP = f"STRUCT<schema: BIGINT, sessionId: STRING, step: BIGINT, systemPrompt: STRING, kind: STRING, messages: ARRAY<{MESSAGE}>>"
#: Parts that mark a message as a trace, fixed values.
REASONING = ("reasoning", "thinking", "trace")


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, step, session, prompt, kind, messages, fault): each line of each tape, in order.

    ``fault`` says why a line is unfit: no JSON, a schema other than 1, a step below 0, no messages, or a session other than
    the file's first. Lines with a ``kind`` are control rows and need no messages. A prompt holds until the next; a step without
    a number has its position. A tape is one row while it is split: it is the history of one session.
    """
    from pyspark.sql import Window as W

    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).where(F.trim("text") != "")
    rows = lines.select("file", (F.col("line") + 1).cast("long").alias("line"), F.try_parse_json("text").isNotNull().alias("_ok"), F.from_json("text", STEP).alias("r"))
    order = W.partitionBy("file").orderBy("line")
    payload = W.partitionBy("file", F.col("r.kind").isNull()).orderBy("line")
    first = F.first("r.sessionId", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    fault = (
        F.when(~F.col("_ok"), "no JSON")
        .when(F.coalesce(F.col("r.schema"), F.lit(1)) != 1, "schema is not 1")
        .when(F.col("r.step") < 0, "step is negative")
        .when(F.col("r.messages").isNull() & F.col("r.kind").isNull(), "messages is no array")
        .when(F.col("r.sessionId") != first, "session changes")
    )
    prompt = F.last("r.systemPrompt", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("file", "line", F.coalesce("r.step", F.row_number().over(payload)).cast("long").alias("step"), F.coalesce("r.sessionId", first, F.lit("tape")).alias("session"), prompt.alias("prompt"), "r.kind", "r.messages", fault.alias("fault"))


def checked(tape: DataFrame) -> DataFrame:
    """The tape, or an error at its first unfit line."""
    said = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("fault"))
    return tape.withColumn("step", F.when(F.col("fault").isNull(), F.col("step")).otherwise(F.raise_error(said))).drop("fault")


def part_text(part: Column) -> Column:
    """A part's text; a part without any is shown as its type and JSON, cut at 2000 characters."""
    shown = F.concat(F.lit("["), F.coalesce(part["type"], F.lit("part")), F.lit("] "), F.substring(F.to_json(part), 1, 2000))
    return F.coalesce(part["text"], shown)


def adapted(tape: DataFrame) -> DataFrame:
    """(session, step, seq, id, kind, role, text, tokens, known): the messages of each payload step as segments.

    A reasoning part makes an assistant's message a trace; unknown roles are pinned and not ``known``; empty texts are left out.
    """
    rows = tape.where("kind IS NULL").select("session", "step", F.posexplode("messages").alias("seq", "m"))
    text = F.trim(F.array_join(F.transform(F.coalesce("m.content", F.array().cast(f"ARRAY<{PART}>")), part_text), "\n"))
    thinks = F.exists("m.content", lambda p: p["type"].isin(*REASONING))
    role = F.col("m.role")
    kind = F.when((role == "assistant") & F.coalesce(thinks, F.lit(False)), "trace").when(role == "assistant", "assistant").when(role == "user", "user").when(role == "tool", "toolResult").otherwise("systemPinned")
    known = F.coalesce(role.isin("user", "assistant", "tool", "system", "developer"), F.lit(False))
    out = rows.select("session", "step", F.col("seq").cast("long").alias("seq"), F.coalesce("m.id", F.concat(F.lit("m"), F.col("seq").cast("string"))).alias("id"), kind.alias("kind"), role.alias("role"), text.alias("text"), known.alias("known"))
    return out.where("text <> ''").withColumn("tokens", estimate_tokens(F.col("text")))
