"""Replaying tapes: segments of each step, pairs, recall and a record for each step, with a digest of all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import pairs, recall
from weftline.plans.policy import Policy
from weftline.sources.tape import adapted


def state_proxy(segments: DataFrame, limit: int, keep_tail: bool = False) -> DataFrame:
    """(session, step, proxy): assistant and trace texts after the last user's, joined, cut to ``limit`` characters and a mark."""
    last = F.max(F.when(F.col("kind") == "user", F.col("idx"))).over(W.partitionBy("session", "step"))
    own = segments.withColumn("_a", last).where((F.col("idx") > F.coalesce("_a", F.lit(-1))) & F.col("kind").isin("assistant", "trace"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    mark = "[trace truncated]"
    rows = own.groupBy("session", "step").agg(joined.alias("t"))
    cut = F.concat(F.lit(mark), F.substring("t", -(limit - len(mark)), limit)) if keep_tail else F.concat(F.substring("t", 1, limit - len(mark)), F.lit(mark))
    return rows.select("session", "step", F.when(F.length("t") <= limit, F.col("t")).otherwise(cut).alias("proxy"))


def records(tape: DataFrame, policy: Policy) -> DataFrame:
    """(session, step, segments, tokens, anchor, hits, recalled_tokens): what each step of a checked tape would assemble."""
    seg = adapted(tape).withColumn("idx", (F.row_number().over(W.partitionBy("session", "step").orderBy("seq")) - 1).cast("long"))
    walk = seg.withColumn("session", F.concat_ws("/", "session", F.col("step").cast("string")))
    scores = pairs.lexical_scores(walk, policy.values["recall.window"])
    seeds = walk.where("kind <> 'systemPinned'").groupBy("session").agg(F.max("idx").alias("seed"))
    hits = recall.recall(seeds, recall.walkable(scores, seeds, policy.values["recall.threshold"]), policy.values["recall.depth"])
    found = hits.join(walk.select("session", "idx", "tokens"), ["session", "idx"]).groupBy("session").agg(F.count("*").alias("hits"), F.sum("tokens").alias("recalled_tokens"))
    steps = walk.groupBy("session").agg(F.count("*").alias("segments"), F.sum("tokens").alias("tokens"))
    zero = F.lit(0).cast("long")
    out = steps.join(seeds.withColumnRenamed("seed", "anchor"), "session", "left").join(found, "session", "left")
    return out.select(F.substring_index("session", "/", 1).alias("session"), F.substring_index("session", "/", -1).cast("long").alias("step"), "segments", "tokens", "anchor", F.coalesce("hits", zero).alias("hits"), F.coalesce("recalled_tokens", zero).alias("recalled_tokens"))


def digest(rows: DataFrame) -> DataFrame:
    """(session, digest): SHA-256 over each session's records as JSON with sorted keys, in order of step."""
    one = F.to_json(F.struct(*sorted(c for c in rows.columns)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("step", one.alias("j")))), lambda x: x["j"])
    return rows.groupBy("session").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))
