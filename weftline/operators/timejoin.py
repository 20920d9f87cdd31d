"""As-of joins with tolerance and interval attribution, by one sort of each key's rows instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.checkpoints import checkpointed


def asof(left: DataFrame, right: DataFrame, by: str, payload: list[str], forward: bool = False, strict: bool = False, tolerance: int | None = None) -> DataFrame:
    """Each left row (by, ts, ...) with the ``payload`` and ``matched_ts`` of the nearest right row before it (or after it).

    Rows at the same time match unless ``strict``; rows further away than ``tolerance`` don't. Of right rows at one time the
    greatest payload is taken. Both sides need ``ts``; unmatched left rows keep nulls.
    """
    names = [c for c in left.columns if c not in (by, "ts")]
    blank = lambda cols, df: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    found = right.groupBy(by, "ts").agg(F.max(F.struct(*payload)).alias("_p")).select(by, "ts", "_p.*") if payload else right.select(by, "ts").distinct()
    # ties: a right row comes first if it may match at the same time
    first = 1 if strict else -1
    rights = found.select(by, "ts", F.lit(first).alias("_side"), *blank(names, left), F.struct("ts", *payload).alias("_m"))
    lefts = left.select(by, "ts", F.lit(0).alias("_side"), *names).withColumn("_m", F.lit(None).cast(rights.schema["_m"].dataType))
    order = [F.desc("ts"), "_side"] if forward else ["ts", "_side"]
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    done = lefts.unionByName(rights).withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 0")
    if tolerance is not None:
        done = done.withColumn("_m", F.when(F.abs(F.col("_m.ts") - F.col("ts")) <= tolerance, F.col("_m")))
    return done.select(by, "ts", *names, F.col("_m.ts").alias("matched_ts"), *[F.col(f"_m.{c}").alias(c) for c in payload])


def attribute(records: DataFrame, frames: DataFrame, by: str, frame: str) -> DataFrame:
    """Each record with the frame (by, frame, start, end) that holds its ts, both ends inclusive, an open end unbounded.

    Frames of a key must not overlap but at ends; at a shared end the earlier frame gets the record. Records in no frame have
    a null ``frame`` and a ``scope``: pre (before the first), idle (between two) or tail (after the last).
    """
    starts = frames.select(by, F.col("start").alias("ts"), F.struct("start", F.coalesce("end", F.lit(2**62)).alias("end"), F.col(frame).alias("id")).alias("_f"))
    at = asof(records, starts, by, ["_f"], strict=True).withColumnRenamed("_f", "_before").drop("matched_ts")
    at = asof(at, starts, by, ["_f"]).drop("matched_ts")
    ends = frames.groupBy(by).agg(F.max(F.coalesce("end", F.lit(2**62))).alias("_last"))
    at = at.join(ends, by, "left")
    hit = F.when(F.col("_before.end") >= F.col("ts"), F.col("_before.id")).when(F.col("_f.end") >= F.col("ts"), F.col("_f.id"))
    scope = F.when(F.col(frame).isNotNull(), F.lit(frame)).when(F.col("_f").isNull(), "pre").when(F.col("ts") > F.col("_last"), "tail").otherwise("idle")
    return at.withColumn(frame, hit).withColumn("scope", scope).drop("_before", "_f", "_last")


def kth_match(left: DataFrame, right: DataFrame, by: list[str], slack: int) -> DataFrame:
    """Pairs the k-th left row of each key with the k-th right one (both by ts) if they are within ``slack``."""
    w = W.partitionBy(*by).orderBy("ts")
    a, b = (df.select(*by, F.col("ts").alias(f"{side}_ts"), F.row_number().over(w).alias("_k")) for df, side in ((left, "left"), (right, "right")))
    return a.join(b, [*by, "_k"]).where(F.abs(F.col("left_ts") - F.col("right_ts")) <= slack).drop("_k")


def one_to_one(left: DataFrame, right: DataFrame, by: str, tolerance: int) -> DataFrame:
    """(by, id, ts, right_id, right_ts): each left row (by, ts, id), in order of time, with the first right row at or after it that no earlier one took.

    A row whose first free partner is more than ``tolerance`` later stays alone and takes none. Partners are numbered; a row's is the number of
    right rows before it, or the one after its predecessor's if that is more, so that all follow from one running maximum. Rows that would wait too long make
    rounds necessary: of a run of rows that wait for one another, the first such row stays alone, and with it all later ones that even its partner is too late
    for; then the others move up. A round settles the head of every run at once.
    """
    rights = right.select(by, "ts", "id").withColumn("_n", (F.row_number().over(W.partitionBy(by).orderBy("ts", "id")) - 1).cast("long"))
    rights = checkpointed(rights)
    both = left.select(by, "ts", "id", F.lit(0).alias("_side")).unionByName(rights.select(by, "ts", "id", F.lit(1).alias("_side")))
    before = F.sum("_side").over(W.partitionBy(by).orderBy("ts", "_side").rowsBetween(W.unboundedPreceding, 0))
    waiting = checkpointed(both.withColumn("_first", before).where("_side = 0").select(by, "ts", "id", "_first"))
    alone = []
    order = W.partitionBy(by).orderBy("ts", "id")
    partners = rights.select(by, F.col("_n").alias("_at"), F.col("id").alias("right_id"), F.col("ts").alias("right_ts"))
    while True:
        placed = waiting.withColumn("_k", F.row_number().over(order) - 1)
        placed = placed.withColumn("_at", F.col("_k") + F.max(F.col("_first") - F.col("_k")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        placed = placed.withColumn("_run", F.sum((F.col("_at") == F.col("_first")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        met = placed.join(partners, [by, "_at"], "left")
        late = F.col("right_ts").isNull() | (F.col("right_ts") - F.col("ts") > tolerance)
        met = checkpointed(met.withColumn("_late", late))
        heads = met.where("_late").groupBy(by, "_run").agg(F.min(F.struct("_k", "right_ts")).alias("_h"))
        if heads.isEmpty():
            break
        told = met.join(heads, [by, "_run"], "left")
        gone = F.coalesce((F.col("_k") >= F.col("_h._k")) & (F.col("_h.right_ts").isNull() | (F.col("_h.right_ts") - F.col("ts") > tolerance)), F.lit(False))
        told = checkpointed(told.select(by, "ts", "id", "_first", gone.alias("_gone")))
        alone.append(told.where("_gone").select(by, "id", "ts"))
        waiting = told.where("NOT _gone").drop("_gone")
    done = met.select(by, "id", "ts", "right_id", "right_ts")
    for rows in alone:
        done = done.unionByName(rows.withColumn("right_id", F.lit(None).cast(right.schema["id"].dataType)).withColumn("right_ts", F.lit(None).cast("long")))
    return done
