"""Plans that an agent states: numbered or bulleted lines of its messages, and to-do lists in its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.session_log import string_at

#: A step of a plan within a text, how many steps count and how long a summary may be, a to-do's states and its event; fixed values.
STEP = r"^\s*(?:\d+[.)]|[-*+])\s+(\S.*)$"
MOST, LONGEST = 3, 400
STATES = ("pending", "in_progress", "completed")
TODO = "todo/write"


def _numbered(rows: DataFrame, keys: tuple[str, ...], summaries: Column, most: int) -> DataFrame:
    """(keys..., step, id, summary): the first ``most`` of an array of summaries, the long ones cut."""
    cut = F.when(F.length("_s") > LONGEST, F.concat(F.substring("_s", 1, LONGEST), F.lit("..."))).otherwise(F.col("_s"))
    found = rows.select(*keys, F.posexplode(F.slice(summaries, 1, max(1, most))).alias("_i", "_s"))
    return found.select(*keys, (F.col("_i") + 1).cast("long").alias("step"), F.concat(F.lit("p"), F.col("_i") + 1).alias("id"), cut.alias("summary"))


def stated_plans(messages: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """(keys..., step, id, summary): a message's (keys..., text) first steps, one a line. Lines that only hold a dash are no steps; nulls have none."""
    steps = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n"), lambda s: F.rlike(s, F.lit(STEP)))
    return _numbered(messages, keys, F.transform(steps, lambda s: F.trim(F.regexp_extract(s, STEP, 1))), most)


def todos(events: DataFrame, *keys: str) -> DataFrame:
    """(keys..., items: array<struct<content, status>>) of (keys..., event: VARIANT): to-do lists as logged, without items that have no text or a
    strange state. Events without any such item have no row."""
    items = F.try_variant_get("event", "$.data.todos", "array<variant>")
    read = F.transform(items, lambda x: F.struct(string_at(x, "$.content").alias("content"), string_at(x, "$.status").alias("status")))
    good = F.filter(read, lambda x: x["content"].isNotNull() & F.coalesce(x["status"].isin(*STATES), F.lit(False)))
    return events.where(string_at(F.col("event"), "$.type") == TODO).select(*keys, good.alias("items")).where(F.size("items") > 0)


def open_todos(lists: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """(keys..., step, id, summary): the first steps of each list that are not completed or blank, in the order of the log."""
    left = F.filter("items", lambda x: (x["status"] != "completed") & (F.trim(x["content"]) != ""))
    return _numbered(lists, keys, F.transform(left, lambda x: F.trim(x["content"])), most)


