"""Reply trees to conversations: root-to-leaf paths by self-joins, ranked by score, each formatted with a loss mask.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A control string inside a role or text gets a backslash
after its first character (one more, if some are there already), so none is left as it is and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, id_back, saved

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings, fixed values, each cut after its first character: those of the template and of common models.
CONTROLS = r"(\|(?:im_start|im_end|endoftext|startoftext|system|user|assistant|eot_id|start_header_id|end_header_id|begin_of_text|end_of_text)\|>|/?s>|<SYS>>|</SYS>>)"
BRACKETS = r"(/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)" + CONTROLS, r"<\\$1$2"), r"\[(\\*)" + BRACKETS, r"[\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)" + CONTROLS, "<$1$2"), r"\[\\(\\*)" + BRACKETS, "[$1$2")


def one_line(role: Column) -> Column:
    """A role with backslashes written as backslash and b, line feeds as backslash and n: it ends at the template's line feed."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def role_back(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _doubled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Path totals by pointer doubling: joins a message's first 2^k ancestors with theirs until every path ends at its root.

    Returns (_t, _m, _n, _s): length and summed score of each message's path from the root, and for each k the table
    (_t, _m, _up) of ancestors 2^k up. A message that has reached its root takes part as a target only, so short trees cost
    nothing while long ones go on. Messages on or below a cycle reach no root and are left out.
    """
    columns = ["_t", "_m", "_up", "_n", "_s"]
    step, jumps, ended, left = saved(links.select("_t", "_m", F.col("_p").alias("_up"), F.lit(1).cast("long").alias("_n"), "_s")), [], None, None
    while True:
        new = step.where("_up IS NULL")
        ended = new if ended is None else ended.union(new)
        going = step.where("_up IS NOT NULL")
        n = going.count()
        if not n or n == left:
            return ended.drop("_up"), jumps
        left = n
        jumps.append(going.select("_t", "_m", "_up"))
        over = ended.union(going).select("_t", F.col("_m").alias("_up"), F.col("_up").alias("_up2"), F.col("_n").alias("_n2"), F.col("_s").alias("_s2"))
        step = saved(going.join(over, ["_t", "_up"]).select("_t", "_m", F.col("_up2").alias("_up"), (F.col("_n") + F.col("_n2")).alias("_n"), (F.col("_s") + F.col("_s2")).alias("_s")).select(*columns))


def paths(messages: DataFrame, best: int) -> DataFrame:
    """(_t, _leaf, _rank, _m, _back): the messages of the ``best`` root-to-leaf paths of each tree, by mean score, then length."""
    known = messages.select("_t", F.col("_m").alias("_p"), F.lit(True).alias("_there"))
    links = messages.select("_t", "_m", "_p", "_s").join(known, ["_t", "_p"], "left").select("_t", "_m", F.when(F.col("_there"), F.col("_p")).alias("_p"), "_s")
    total, jumps = _doubled(links)
    parents = links.where("_p IS NOT NULL").select("_t", F.col("_p").alias("_m")).distinct()
    leaves = total.join(parents, ["_t", "_m"], "left_anti")
    order = W.partitionBy("_t").orderBy(F.desc(F.col("_s") / F.col("_n")), F.desc("_n"), "_m")
    on = leaves.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= best).select("_t", F.col("_m").alias("_leaf"), "_rank", "_m", F.lit(0).cast("long").alias("_back"))
    for k in range(len(jumps) - 1, -1, -1):
        up = on.join(jumps[k], ["_t", "_m"], "left")
        both = F.array(F.struct("_m", "_back"), F.when(F.col("_up").isNotNull(), F.struct(F.col("_up").alias("_m"), (F.col("_back") + 2**k).alias("_back"))))
        on = up.select("_t", "_leaf", "_rank", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_x")).select("_t", "_leaf", "_rank", "_x.*")
    return on


def chat_format(
    messages: DataFrame, tree_col: str = "tree_id", message_col: str = "message_id", parent_col: str = "parent_id", score_col: str | None = "score", role_col: str = "role", text_col: str = "text", best: int = 1, loss_role: str = "assistant"
) -> DataFrame:
    """Formats the ``best`` root-to-leaf paths of each reply tree, one row for each path.

    Returns ``tree_id, branch`` (1 is best), ``leaf, n_turns, formatted`` and ``loss_spans`` (start from 0 and length, in code points of
    ``formatted``, of each text of ``loss_role``). Branches rank by the mean score of their messages, then by length, then by the
    leaf's id. A parent that is missing counts as none; messages on or below a cycle reach no root and are left out. Null texts
    and roles are empty, null scores 0, null trees one tree of their own; of several messages with one id in a tree the least by
    role and text stays; messages without an id are left out; an empty table gives no rows.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    read = messages.select(
        F.coalesce(F.col(tree_col).cast("long"), F.lit(NO_ID)).alias("_t"), F.col(message_col).cast("long").alias("_m"), F.col(parent_col).cast("long").alias("_p"), score.alias("_s"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    ).where("_m IS NOT NULL")
    once = W.partitionBy("_t", "_m").orderBy("_role", "_text", "_p", "_s")
    read = read.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    head = F.concat(F.lit(START), escaped(one_line(F.col("_role"))), F.lit("\n"))
    body = escaped(F.col("_text"))
    turns = paths(read, best).join(read.select("_t", "_m", "_role", head.alias("_head"), body.alias("_body")), ["_t", "_m"])
    turns = turns.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    before = W.partitionBy("_t", "_leaf").orderBy(F.desc("_back")).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.length("_head"))
    span = F.when(F.col("_role") == loss_role, F.struct(F.col("_at").cast("long").alias("start"), F.length("_body").cast("long").alias("length")))
    rows = turns.groupBy("_t", "_leaf", "_rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col("_piece").alias("piece"), span.alias("span")))).alias("_all"))
    return rows.select(
        id_back("_t").alias("tree_id"), F.col("_rank").alias("branch"), F.col("_leaf").alias("leaf"), F.size("_all").cast("long").alias("n_turns"), F.array_join(F.transform("_all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def turns_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    inner = F.transform(parts, lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    return F.transform(inner, lambda p: F.struct(role_back(unescaped(F.substring_index(p, "\n", 1))).alias("role"), unescaped(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def as_chain(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Messages of a table without parents: each row replies to the one before it in its group."""
    w = W.partitionBy(group).orderBy(*order)
    numbered = rows.withColumn("message_id", F.row_number().over(w).cast("long"))
    return numbered.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
