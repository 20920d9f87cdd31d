"""Recall trees as nested JSON and back: levels folded from the deepest up, and opened from the root down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.checkpoints import checkpointed


def nested(nodes: DataFrame, depth: int) -> DataFrame:
    """(session, tree) of a walk's (session, idx, via, depth), depth 0 being the seeds': {"seed": {"hit": {...}}}, hits of one parent in order of idx.

    Each step folds one level into its parents; a session's tree is one string in the end, as it is in the log.
    """
    line = lambda below: F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('":{'), below, F.lit("}"))
    kids = None
    for k in range(depth, -1, -1):
        level = nodes.where(F.col("depth") == k).select("session", "idx", "via")
        below = F.lit("")
        if kids is not None:
            level = level.join(kids, ["session", "idx"], "left")
            below = F.coalesce("_t", F.lit(""))
        parts = level.select("session", F.col("via").alias("idx") if k else F.lit(None).alias("idx"), F.struct(F.col("idx").alias("i"), line(below).alias("t")).alias("_n"))
        kids = parts.groupBy("session", "idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_n")), lambda n: n["t"]), ",").alias("_t"))
    return kids.select("session", F.concat(F.lit("{"), "_t", F.lit("}")).alias("tree"))


def flattened(trees: DataFrame, depth: int) -> DataFrame:
    """(session, id, via, depth, fault) of (session, tree): every node of each tree, the root at depth 0 without ``via``.

    Faults: ``no tree`` (no JSON object, a key twice in one object, or no root; without an id), ``second root`` (of the keys at the top all but the first),
    ``twice`` (an id that another node of the tree has too), ``no object`` (a node that is none), ``deeper`` (a node at ``depth`` that has others below it, which are not
    opened). One level is opened at a time, all sessions at once.
    """
    spark = trees.sparkSession
    read = trees.select("session", F.try_parse_json("tree").alias("_v"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    level = read.select("session", F.lit(None).cast("string").alias("id"), F.when(is_object(F.col("_v")), F.col("_v")).alias("_v"))
    found: list[DataFrame] = []
    for k in range(depth + 1):
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value")))
        text = opened.select("session", F.col("_key").alias("id"), F.col("id").alias("via"), F.lit(k).alias("depth"), is_object(F.col("_value")).alias("_object"), F.to_json("_value").alias("_json"))
        done = checkpointed(text)
        found.append(done)
        level = done.where("_object AND _json <> '{}'").select("session", "id", F.parse_json("_json").alias("_v"))
        if level.isEmpty():
            break
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    times = F.count("*").over(W.partitionBy("session", "id"))
    root = F.row_number().over(W.partitionBy("session", "depth").orderBy("id"))
    rows = whole.withColumn("_times", times).withColumn("_root", F.when(F.col("depth") == 0, root))
    opened_not = (F.col("depth") == depth) & F.col("_object") & (F.col("_json") != "{}")
    fault = F.when((F.col("_root") > 1), "second root").when(F.col("_times") > 1, "twice").when(~F.col("_object"), "no object").when(opened_not, "deeper")
    kept = rows.where("id IS NOT NULL").select("session", "id", "via", "depth", fault.alias("fault"))
    none = trees.select("session").distinct().join(rows.where("id IS NOT NULL").select("session").distinct(), "session", "left_anti")
    return kept.unionByName(none.select("session", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("depth"), F.lit("no tree").alias("fault")))


def layers(nodes: DataFrame) -> DataFrame:
    """(session, depth, nodes) of flattened trees without faults: how many nodes each layer has, the root not counted."""
    return nodes.where("fault IS NULL AND depth > 0").groupBy("session", "depth").agg(F.count("*").alias("nodes"))
