"""Selecting context for a session's last input: exclusions, fallbacks, order, budget; and delivering only what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import estimate_tokens, payload_id
from weftline.operators.containment import contained, texts


def selected(placed: DataFrame, hits: DataFrame, scores: DataFrame, window: int, least: int = 1) -> DataFrame:
    """(session, idx, tokens, why): the recalled part of the context of each session.

    Hits that are pinned, in the tail or the anchor are left out (``why`` recalled). A walk without hits admits the segments of
    the window that no model has judged (unjudged). A session with fewer than ``least`` hits and nothing admitted falls back to
    its whole history (recency). Segments, hits and judged pairs are marks on (session, idx) that are moved once, by session.
    """
    none = F.lit(None).cast("boolean")
    seeds = placed.where("place = 'anchor'").select("session", F.col("idx").alias("_seed"))
    # scores into the seeds; no join on both keys, so that scores stay with their sessions
    judged = scores.where("source = 's1-noul'").select("session", "from_idx", "to_idx").join(seeds, "session").where(F.col("to_idx") - F.col("_seed") == 0)
    marks = placed.select("session", "idx", "tokens", "place", none.alias("_hit"), none.alias("_judged"))
    for rows, hit, told in ((hits.select("session", "idx"), F.lit(True), none), (judged.select("session", F.col("from_idx").alias("idx")), none, F.lit(True))):
        marks = marks.unionByName(rows.select("session", "idx", hit.alias("_hit"), told.alias("_judged")), allowMissingColumns=True)
    each = marks.repartition("session").groupBy("session", "idx").agg(F.max("tokens").alias("tokens"), F.max("place").alias("place"), F.max("_hit").alias("_hit"), F.max("_judged").alias("_judged"))
    every = W.partitionBy("session")
    each = each.withColumn("_seed", F.max(F.when(F.col("place") == "anchor", F.col("idx"))).over(every)).withColumn("_walked", F.max("_hit").over(every)).where("place = 'history'")
    near = F.col("idx").between(F.col("_seed") - window, F.col("_seed") - 1) & F.col("_walked").isNull() & F.col("_judged").isNull() & F.col("session").isNotNull()
    each = each.withColumn("_admitted", F.coalesce(near, F.lit(False))).withColumn("_found", F.coalesce("_hit", F.lit(False)))
    enough = (F.count_if("_found").over(every) >= max(least, 1)) | F.max("_admitted").over(every)
    why = F.when(~F.col("_enough"), "recency").when(F.col("_found"), "recalled").when(F.col("_admitted"), "unjudged")
    return each.withColumn("_enough", enough).withColumn("why", why).where("why IS NOT NULL").select("session", "idx", "tokens", "why")


def budget(placed: DataFrame, chosen: DataFrame, context: int, reserve: int) -> DataFrame:
    """(session, blocks..., used, total, stable, after_cut, would_save): tokens by block and the prefix that stays cacheable.

    The layout is pinned, tail, recalled, anchor; pinned and tail are the stable head.
    """
    blocks = placed.groupBy("session").agg(*[F.coalesce(F.sum(F.when(F.col("place") == p, F.col("tokens"))), F.lit(0)).alias(p) for p in ("pinned", "tail", "anchor", "history")])
    recalled = chosen.groupBy("session").agg(F.sum("tokens").alias("recalled"), F.max("why").alias("why"))
    joined = blocks.join(recalled, "session", "left").withColumn("recalled", F.coalesce("recalled", F.lit(0)))
    used = F.col("pinned") + F.col("tail") + F.col("recalled") + F.col("anchor")
    full = F.col("pinned") + F.col("tail") + F.col("history") + F.col("anchor")
    stable = F.col("pinned") + F.col("tail")
    return joined.select("session", "pinned", "tail", "recalled", "anchor", "why", used.alias("used"), F.lit(context - reserve).cast("long").alias("total"), stable.alias("stable"), (used - stable).alias("after_cut"), F.greatest(F.lit(0), full - used).alias("would_save"))


def rendered(kind: Column, parent: Column, text: Column) -> Column:
    """A segment as it is quoted: a line that says where it comes from, and its text. The line's words are fixed values."""
    return F.concat(F.lit("## earlier "), kind, F.lit(" turn, quoted verbatim · "), parent, F.lit("\n"), text)


def provenance_ids(payload: Column) -> Column:
    """The parents that a payload of rendered segments names, in order."""
    return F.regexp_extract_all(payload, F.lit(r"(?m)^## earlier \w+ turn, quoted verbatim · (.*)$"), F.lit(1))


#: Kinds whose text proves that they are visible, wherever it stands, and the characters from which a part of a text is proof too; fixed values.
SHOWN_KINDS, SHOWN_LENGTH = ("user", "toolResult"), 128


def visible(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """(session, idx): the wanted segments (session, idx, kind, parent, text) that the session's shown messages (session, id, text, injected) have.

    A user's or a tool's text is there if it is a message's text, or at least ``SHOWN_LENGTH`` characters of one; any text is there if it is part of
    the message it was cut from (``parent``), or if an injected message quotes it as rendered. Empty texts are never there.
    """
    some = wanted.where(F.length("text") > 0)
    free = some.where(F.col("kind").isin(*SHOWN_KINDS))
    equal = free.join(shown.select("session", "text").distinct(), ["session", "text"], "left_semi").select("session", "idx")
    ids = shown.select("session", F.col("id").alias("_hay"), "text", "injected")
    hays = texts(ids, ["session"], "_hay", "text")
    within = contained(texts(free.where(F.length("text") >= SHOWN_LENGTH), ["session"], "idx", "text"), hays)
    own = some.join(shown.select("session", F.col("id").alias("parent"), F.col("text").alias("_whole")), ["session", "parent"]).where(F.contains("_whole", "text")).select("session", "idx")
    quoted = some.withColumn("_r", rendered(F.col("kind"), F.col("parent"), F.col("text")))
    again = contained(texts(quoted, ["session"], "idx", "_r"), texts(ids.where("injected"), ["session"], "_hay", "text"))
    found = [df.select(F.col("_by").alias("session"), F.col("_needle").alias("idx")) for df in (within, again)]
    return equal.unionByName(own).unionByName(found[0]).unionByName(found[1]).distinct()


def missing(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """(session, idx, text, payload): wanted segments whose text is not visible already; equal texts once, the oldest."""
    first = wanted.join(shown.select("session", "text").distinct(), ["session", "text"], "left_anti").groupBy("session", "text").agg(F.min("idx").alias("idx"))
    return first.select("session", "idx", "text", payload_id("seg-", F.col("text")).alias("payload"))


def _scanned(rows: DataFrame, max_tokens: int, max_segments: int) -> DataFrame:
    """(session, idx, pos, tokens, outcome) of (session, idx, pos, tokens, key, shown): sessions stream through a task in order of pos.

    duplicate: a row of the same key was delivered; visible: it is shown; deferred: it doesn't fit; else delivered. The state is two sums and
    the keys that were delivered.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, used, keys = None, 0, set()
        count = 0
        for batch in batches:
            out = []
            for s, n, key, shown in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if s != session:
                    session, used, count, keys = s, 0, 0, set()
                if key is not None and key in keys:
                    out.append("duplicate")
                elif shown:
                    out.append("visible")
                elif (max_tokens and used + n > max_tokens) or (max_segments and count >= max_segments):
                    out.append("deferred")
                else:
                    used, count = used + n, count + 1
                    keys.add(key)
                    out.append("delivered")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], [*batch.schema.names[:4], "outcome"])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.select("session", *[F.col(c).cast("long").alias(c) for c in ("idx", "pos", "tokens")], "key", "shown")
    return some.repartition(partitions, "session").sortWithinPartitions("session", "pos", "idx").mapInArrow(scan, f"session {dict(rows.dtypes)['session']}, idx long, pos long, tokens long, outcome string")


def within_budget(rows: DataFrame, max_tokens: int, max_segments: int) -> DataFrame:
    """(session, idx, pos, tokens, delivered): a greedy scan by ``pos`` that defers a block that doesn't fit and goes on. 0 means no limit."""
    plain = rows.withColumn("key", F.lit(None).cast("string")).withColumn("shown", F.lit(False))
    return _scanned(plain, max_tokens, max_segments).select("session", "idx", "pos", "tokens", (F.col("outcome") == "delivered").alias("delivered"))


#: Why nothing is delivered, in the order in which it is asked.
REFUSALS = ("off", "no step", "no messages", "deferred", "nothing to insert", "already there")


def delivery(steps: DataFrame, wanted: DataFrame, shown: DataFrame, max_tokens: int = 0, max_segments: int = 0) -> DataFrame:
    """(session, reason, candidates, visible, duplicates, deferred, delivered, tokens, payload, at): what each step (session, enabled, step, every_step,
    messages) gets of its wanted segments (session, idx, kind, parent, text).

    ``messages`` are the step's own, an array of structs (text, claimed). Wanted segments go in order of idx: those whose text was not delivered yet and is
    not ``visible``, as far as the budget goes. ``at`` is where the payload goes: after the last claimed message, or at the end. A step that gets
    nothing has the first of ``REFUSALS`` that holds for ``reason``, and no payload.
    """
    known = steps.select("session", "enabled", "step", "every_step", "messages")
    marked = wanted.withColumn("_r", rendered(F.col("kind"), F.col("parent"), F.col("text"))).join(visible(wanted, shown).withColumn("shown", F.lit(True)), ["session", "idx"], "left")
    asked = marked.select("session", "idx", F.col("idx").alias("pos"), estimate_tokens(F.concat(F.lit("\n\n"), "_r")).alias("tokens"), F.sha2("text", 256).alias("key"), F.coalesce("shown", F.lit(False)).alias("shown"))
    told = _scanned(asked, max_tokens, max_segments).join(marked.select("session", "idx", "_r"), ["session", "idx"])
    sent = F.col("outcome") == "delivered"
    parts = F.transform(F.sort_array(F.collect_list(F.when(sent, F.struct("idx", "_r")))), lambda x: x["_r"])
    names = {"visible": "visible", "duplicates": "duplicate", "deferred": "deferred", "delivered": "delivered"}
    counts = [F.count_if(F.col("outcome") == name).alias(column) for column, name in names.items()]
    sums = told.groupBy("session").agg(F.count("*").alias("candidates"), *counts, F.coalesce(F.sum(F.when(sent, F.col("tokens"))), F.lit(0)).alias("tokens"), F.array_join(parts, "\n\n").alias("_text"))
    zero = ["candidates", "visible", "duplicates", "deferred", "delivered", "tokens"]
    both = known.join(sums, "session", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
    empty = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    there = F.exists("messages", lambda m: m["text"] == F.col("_text"))
    tests = (~F.col("enabled"), (F.col("step") == 1) & empty, empty & ~F.col("every_step"), (F.col("delivered") == 0) & (F.col("deferred") > 0), F.col("delivered") == 0, there)
    reason = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, REFUSALS, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    last = F.array_max(F.transform("messages", lambda m, i: F.when(m["claimed"], i + 1)))
    both = both.withColumn("reason", reason)
    sent = F.col("reason").isNull()
    return both.select("session", "reason", *zero, F.when(sent, payload_id("seg-", F.col("_text"))).alias("payload"), F.when(sent, F.coalesce(last, F.size("messages"))).cast("long").alias("at"))


def not_contained(rows: DataFrame) -> DataFrame:
    """(session, parent, idx, kept): siblings of one parent in order of ``pos``; one that an earlier kept text contains is dropped.

    As containment is transitive, that is one that any earlier text contains. An empty text is in every earlier one.
    """
    found = contained(*[texts(rows, ["session", "parent"], "pos", "text")] * 2, same=True).where("_hay < _needle").select("_by.session", "_by.parent", F.col("_needle").alias("pos")).distinct()
    first = F.min("pos").over(W.partitionBy("session", "parent"))
    told = rows.withColumn("_first", first).join(found.withColumn("_in", F.lit(True)), ["session", "parent", "pos"], "left")
    empty = (F.length("text") == 0) & (F.col("pos") > F.col("_first"))
    return told.select("session", "parent", "idx", (~(F.coalesce("_in", F.lit(False)) | empty)).alias("kept"))


def selection_order(steps: DataFrame) -> DataFrame:
    """(session, step, idx, place): places by first selection; survivors keep their order, arrivals come after, by idx."""
    first = steps.groupBy("session", "idx").agg(F.min("step").alias("_first"))
    return steps.join(first, ["session", "idx"]).select("session", "step", "idx", F.row_number().over(W.partitionBy("session", "step").orderBy("_first", "idx")).cast("long").alias("place"))


def shortenable(results: DataFrame, rejections: DataFrame, protect: int, least: int, share: float) -> DataFrame:
    """(session, idx, tokens): old tool results that the model explicitly rejected, if shortening them saves enough.

    The last ``protect`` segments of a session stay whole; a session saves at least ``least`` tokens and that share of its own.
    """
    back = F.row_number().over(W.partitionBy("session").orderBy(F.desc("idx")))
    old = results.withColumn("_r", back).withColumn("_all", F.sum("tokens").over(W.partitionBy("session"))).where(F.col("_r") > protect)
    cut = old.join(rejections.select("session", "idx").distinct(), ["session", "idx"], "left_semi").withColumn("_save", F.sum("tokens").over(W.partitionBy("session")))
    return cut.where((F.col("_save") >= least) & (F.col("_save") >= share * F.col("_all"))).select("session", "idx", "tokens")


def plan_order(plans: DataFrame, min_confidence: float) -> DataFrame:
    """(set_id, id, p, place, abstained): scores normalised over each set; uniform if none is finite and positive.

    Abstains if the best confidence is under the bound or nothing was scored; then plans stay in order of id.
    """
    w = W.partitionBy("set_id")
    good = F.when(~F.isnan("score") & (F.col("score") > 0) & (F.col("score") < float("inf")), F.col("score"))
    rows = plans.withColumn("_s", F.sum(good).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_c", F.max("confidence").over(w))
    p = F.when(F.col("_s") > 0, F.coalesce(good, F.lit(0.0)) / F.col("_s")).otherwise(1 / F.col("_n"))
    rows = rows.withColumn("p", p).withColumn("abstained", F.coalesce(F.col("_c") < min_confidence, F.lit(True)) | F.col("_s").isNull())
    order = W.partitionBy("set_id").orderBy(F.when(F.col("abstained"), F.lit(0.0)).otherwise(-F.col("p")), "id")
    return rows.select("set_id", "id", "p", F.row_number().over(order).cast("long").alias("place"), "abstained")
