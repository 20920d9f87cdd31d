"""Messages and events as segments: (session, idx, seq, kind, role, text, tokens, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import estimate_tokens

#: Closed list of segment kinds, fixed values.
KINDS = ("user", "assistant", "trace", "toolCall", "toolResult", "systemPinned")
#: Record types of the control log, which may never be segments; fixed values.
CONTROL = ("llm_call", "s1_call", "tool_call", "assembly", "plan_gate", "context_delivery")


def kind_of(role: Column) -> Column:
    """user, assistant and tool roles keep a kind of their own; system, developer and unknown roles are pinned."""
    return F.when(role == "user", "user").when(role == "assistant", "assistant").when(role == "tool", "toolResult").otherwise("systemPinned")


def from_messages(rows: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", ts: Column | None = None) -> DataFrame:
    """Segments of a message table; empty texts are left out, idx is the order of arrival in the session."""
    arrival = W.partitionBy("session").orderBy("seq", "role", "text")
    read = rows.select(F.col(session).alias("session"), F.col(order).cast("long").alias("seq"), F.col(role).alias("role"), F.trim(F.col(text)).alias("text"), (ts if ts is not None else F.col(order).cast("long") * 60_000).alias("ts"))
    read = read.where(F.length("text") > 0)
    return read.select("session", (F.row_number().over(arrival) - 1).cast("long").alias("idx"), "seq", kind_of(F.col("role")).alias("kind"), "role", "text", estimate_tokens(F.col("text")).alias("tokens"), "ts")


def from_events(rows: DataFrame, session: str = "user_id") -> DataFrame:
    """Events as segments without text: topic is the rank of the event type, ts in milliseconds."""
    arrival = W.partitionBy("session").orderBy("ts", "event_id")
    topic = F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")).cast("long")
    read = rows.select(F.col(session).alias("session"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_type", "value", topic.alias("topic"))
    return read.withColumn("idx", (F.row_number().over(arrival) - 1).cast("long"))


#: Event types in order, fixed values.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def is_input(kind: Column) -> Column:
    return kind != "systemPinned"


def tail_history(segments: DataFrame, k: int = 3) -> DataFrame:
    """Each session's segments with their place: pinned, anchor (the last input), tail (the k inputs before it) or history."""
    free = is_input(F.col("kind"))
    back = W.partitionBy("session", "_free").orderBy(F.desc("idx"))
    ranked = segments.withColumn("_free", free).withColumn("_r", F.row_number().over(back))
    place = F.when(~F.col("_free"), "pinned").when(F.col("_r") == 1, "anchor").when(F.col("_r") <= k + 1, "tail").otherwise("history")
    return ranked.withColumn("place", place).drop("_free", "_r")


def provenance(rows: DataFrame, kind: str) -> DataFrame:
    """Counts of rows by kind and verdict: segment, control (a control record among segments) or unknown."""
    verdict = F.when(F.col(kind).isin(*KINDS), "segment").when(F.col(kind).isin(*CONTROL), "control").otherwise("unknown")
    return rows.groupBy(F.col(kind).alias("kind"), verdict.alias("verdict")).agg(F.count("*").alias("n"))
