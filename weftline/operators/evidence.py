"""What a run left behind, and what can be read from it: its identity, sessions and snapshots, the window and lane it ran with, coverage, invariants.

A number that can't be read is null, with the reason beside it; nothing is put in its place. Reasons are short fixed texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.scorers import LOCAL, MODEL
from weftline.operators.segments import CONTROL, KINDS
from weftline.operators.session_log import at, string_at

#: Kinds of a run's own records, the window in an edge's provenance, and the heading of a quoted turn; fixed values.
WIRING, TUNING = "wiring", "tuning-file"
EDGE_WINDOW = r"(?:^|;)window:(\d+)(?:;|$)"
QUOTED = r"^## earlier (user|assistant|trace|toolCall|toolResult) turn, quoted verbatim · \S+$"
TURN = "turn/start"


def _object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _filled(record: Column, path: str) -> Column:
    found = string_at(record, path)
    return F.when(found != "", found)


# ---- identity


def run_identity(manifests: DataFrame, block: str = "_host") -> DataFrame:
    """(run, present, reason, version, executable, command, probed_at, provider, model) of (run, text): what a manifest says of the program that ran.

    The first reason that holds: no manifest (null text), no JSON, no block (of the name ``block``), no version. Such rows have no other figures.
    """
    rows = manifests.select("run", "text", F.try_parse_json("text").alias("_doc")).withColumn("_b", at(F.col("_doc"), f"$.{block}"))
    version = _filled(F.col("_b"), "$.version")
    is_block = F.coalesce(_object(F.col("_b")) | F.startswith(F.schema_of_variant("_b"), F.lit("ARRAY")), F.lit(False))
    reason = F.when(F.col("text").isNull(), "no manifest").when(F.col("_doc").isNull(), "no JSON").when(~is_block, "no block").when(version.isNull(), "no version")
    fields = {"version": version, "executable": _filled(F.col("_b"), "$.executable"), "command": string_at(F.col("_b"), "$.command"), "probed_at": _filled(F.col("_b"), "$.probedAt"), "provider": string_at(F.col("_b"), "$.model.provider"), "model": string_at(F.col("_b"), "$.model.model")}
    return rows.withColumn("reason", reason).select("run", F.col("reason").isNull().alias("present"), "reason", *(F.when(F.col("reason").isNull(), c).alias(n) for n, c in fields.items()))


# ---- which of several sources counts


def store_roles(stores: DataFrame, events: DataFrame) -> DataFrame:
    """(cell, path, turns, role) of a cell's stores (cell, path, bytes) and their events (cell, path, type).

    primary: most turns begun, then most bytes, then the first path; ``never ran`` in its place if that one began no turn. Others that began some
    are ``ignored``, and the rest ``stubs``. Stores are not merged.
    """
    begun = events.where(F.col("type") == TURN).groupBy("cell", "path").agg(F.count("*").alias("turns"))
    counted = stores.join(begun, ["cell", "path"], "left").select("cell", "path", "bytes", F.coalesce("turns", F.lit(0)).alias("turns"))
    best = counted.groupBy("cell").agg(F.min_by("path", F.struct(-F.col("turns"), -F.col("bytes"), F.col("path"))).alias("_best"))
    first = F.col("path") == F.col("_best")
    role = F.when(first, F.when(F.col("turns") > 0, "primary").otherwise("never ran")).when(F.col("turns") > 0, "ignored").otherwise("stub")
    return counted.join(best, "cell").select("cell", "path", "turns", role.alias("role"))


def chosen_snapshots(cells: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(cell, path, matches, found, reason) of cells (cell, session) and snapshots (cell, path, session, judged).

    The snapshot of the cell's own session; of several the one with most judged pairs (null counts as 0), then the first path. Another session's
    is never taken: then ``path`` is null, and the reason is ``no snapshots`` or ``other sessions``. ``several`` warns of a choice.
    """
    own = F.when(F.col("session").eqNullSafe(F.col("_s")) & F.col("_s").isNotNull(), F.struct((-F.coalesce("judged", F.lit(0))).alias("j"), "path"))
    met = cells.select("cell", F.col("session").alias("_s")).join(snapshots, "cell", "left").groupBy("cell").agg(F.min(own)["path"].alias("path"), F.count(own).alias("matches"), F.count("path").alias("found"))
    reason = F.when(F.col("found") == 0, "no snapshots").when(F.col("matches") == 0, "other sessions").when(F.col("matches") > 1, "several")
    return met.withColumn("reason", reason)


# ---- the window and the lane that a run had


def window_evidence(cells: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, window, source, candidates, reason) of all ``cells`` (cell), records (cell, pos, record: VARIANT), and edges (cell, provenance).

    Wiring and tuning records and the edges' provenance name windows; those that are no positive finite number are not read. All must agree: else
    there is no window, and the reason is ``records disagree``. ``source`` is the first that named it: records in order, then edges.
    """
    record, kind = F.col("record"), string_at(F.col("record"), "$.kind")
    named = F.when(kind == WIRING, F.try_variant_get(record, "$.recall.w", "double")).when(kind == TUNING, F.try_variant_get(record, "$.effective.window", "double"))
    said = records.select("cell", named.alias("w"), F.struct(F.lit(0).alias("r"), F.col("pos").cast("long").alias("p"), kind.alias("source")).alias("_at"))
    drawn = edges.select("cell", F.regexp_extract("provenance", EDGE_WINDOW, 1).try_cast("double").alias("w"), F.struct(F.lit(1).alias("r"), F.lit(0).cast("long").alias("p"), F.lit("edges").alias("source")).alias("_at"))
    found = said.unionByName(drawn).where(~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf")))
    windows = found.groupBy("cell", F.col("w").cast("long").alias("w")).agg(F.min("_at").alias("_at"))
    each = windows.groupBy("cell").agg(F.sort_array(F.collect_list("w")).alias("candidates"), F.min("_at")["source"].alias("_source"))
    n = F.size(F.coalesce("candidates", F.array().cast("array<bigint>")))
    agreed = lambda c: F.when(n == 1, c)
    reason = F.when(n == 0, "no window recorded").when(n > 1, "records disagree")
    return cells.select("cell").distinct().join(each, "cell", "left").select("cell", agreed(F.get("candidates", F.lit(0))).alias("window"), agreed(F.col("_source")).alias("source"), F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"), reason.alias("reason"))


def lane_state(cells: DataFrame, records: DataFrame, calls: DataFrame) -> DataFrame:
    """(cell, state, provider, configured, conflicts, source) of all ``cells``, records (cell, pos, record) and the lane's calls (cell, pos, provider).

    By authority: the first wiring record that says anything of the lane, then the first tuning record with a provider, then the calls, then
    silence. States: present, none (chosen to be off), demoted (off, but something else was configured), unknown (silence, or a wiring record
    that can't be read and no tuning record before it). ``configured`` and ``conflicts`` are null unless the wiring record has them.
    """
    r, kind = F.col("record"), string_at(F.col("record"), "$.kind")
    lane = at(r, "$.s1")
    off = string_at(r, "$.s1") == "none"
    off_inside = (string_at(r, "$.s1.provider") == "none") | (string_at(r, "$.s1.mode") == "none")
    wired = F.when(F.coalesce(off, F.lit(False)), "none").when(_object(lane), F.when(F.coalesce(off_inside, F.lit(False)), "none").otherwise("present"))
    provider = F.when(F.coalesce(off, F.lit(False)), "none").otherwise(string_at(r, "$.s1.provider"))
    conflicts = F.size(F.try_variant_get(r, "$.conflicts", "array<variant>"))
    wiring = F.when((kind == WIRING) & lane.isNotNull(), F.struct(F.col("pos").cast("long").alias("p"), wired.alias("state"), provider.alias("provider"), F.try_variant_get(r, "$.configuredProvider", "string").alias("configured"), F.when(conflicts >= 0, conflicts.cast("long")).alias("conflicts")))
    tuned = F.try_variant_get(r, "$.effective.provider", "string")
    tuning = F.when((kind == TUNING) & at(r, "$.effective.provider").isNotNull(), F.struct(F.col("pos").cast("long").alias("p"), tuned.alias("provider")))
    told = records.select("cell", wiring.alias("_w"), tuning.alias("_t")).groupBy("cell").agg(F.min("_w").alias("_w"), F.min("_t").alias("_t"))
    asked = calls.groupBy("cell").agg(F.min(F.when(F.col("provider").isNotNull(), F.struct(F.col("pos").alias("p"), "provider")))["provider"].alias("_c"), F.lit(True).alias("_any"))
    by_name = lambda c: F.when(c == "none", "none").otherwise("present")
    before = F.col("_t").isNotNull() & (F.col("_t.p") < F.col("_w.p"))
    plain = F.coalesce(F.col("_w.state"), F.when(before, by_name(F.col("_t.provider"))), F.lit("unknown"))
    demoted = (plain == "none") & F.coalesce(F.col("_w.configured") != "none", F.lit(False))
    first_of = lambda wired, tuned, called, silent: F.when(F.col("_w").isNotNull(), wired).when(F.col("_t").isNotNull(), tuned).when(F.col("_any"), called).otherwise(silent)
    state = first_of(F.when(demoted, "demoted").otherwise(plain), by_name(F.col("_t.provider")), by_name(F.col("_c")), "unknown")
    wired_name = F.coalesce(F.col("_w.provider"), F.when(F.col("_w.state").isNull() & before, F.col("_t.provider")))
    name = first_of(wired_name, F.col("_t.provider"), F.col("_c"), F.lit(None).cast("string"))
    met = cells.select("cell").distinct().join(told, "cell", "left").join(asked, "cell", "left")
    return met.select("cell", state.alias("state"), name.alias("provider"), F.col("_w.configured").alias("configured"), F.col("_w.conflicts").alias("conflicts"), first_of("wiring", "tuning", "calls", "silence").alias("source"))


# ---- coverage


def offered_pairs(n: Column, w: Column) -> Column:
    """The pairs that ``n`` segments in order offer within a window of ``w``: the sum of min(i, w) below n, in closed form."""
    full = F.least(F.greatest(n - 1, F.lit(0)), w)
    return ((full * (full + 1)) / 2).cast("long") + F.greatest(n - 1 - full, F.lit(0)) * w


def _suffix_start(n: Column, w: Column, pairs: Column) -> Column:
    """The largest k >= 1 with the sum of min(i, w) from k below n equal to ``pairs``, or null.

    Where the suffix lies beyond the window its rows have w pairs each; else what is left before it is a triangular number. No scan.
    """
    beyond = F.greatest(n - 1 - w, F.lit(0)) * w
    flat = F.when((w > 0) & (pairs % F.greatest(w, F.lit(1)) == 0), n - (pairs / F.greatest(w, F.lit(1))).cast("long"))
    left = offered_pairs(n, w) - pairs
    root = F.round((1 + F.sqrt(1 + 8 * left.cast("double"))) / 2).cast("long")
    steep = F.when((left >= 0) & (root * (root - 1) == 2 * left) & (root >= 1) & (root < n), root)
    return F.when(pairs <= beyond, flat).otherwise(steep)


def coverage(runs: DataFrame) -> DataFrame:
    """Adds what can be said of each run's coverage to (state, calls, segments, window, window_reason, settled, deferred, cursor, scored, judged).

    segments, settled, deferred and cursor are null where the snapshot doesn't record them, and the window where it is not known.
    ``lane`` is absent, demoted or present; ``floor``, settled of offered pairs, is undefined without a lane, else null with its reason;
    ``deferred_share`` and ``first_refused``, the segment from which on pairs were refused, have reasons of their own; ``judged_share`` is
    judged of scored pairs.
    """
    n, w, deferred = F.col("segments"), F.col("window"), F.col("deferred")
    lane = F.when(F.col("state") == "demoted", "demoted").when((F.col("state") == "none") | ((F.col("state") == "unknown") & (F.coalesce("calls", F.lit(0)) == 0)), "absent").otherwise("present")
    offered_why = F.when(n.isNull(), "no order recorded").when(w.isNull(), F.coalesce("window_reason", F.lit("no window recorded")))
    rows = runs.withColumns({"lane": lane, "offered": F.when(offered_why.isNull(), offered_pairs(n, w))})
    none_offered = F.col("offered") == 0
    floor_why = F.when(F.col("lane") != "present", F.concat(F.lit("lane "), F.col("lane"))).when(F.col("settled").isNull(), "no scores recorded").when(offered_why.isNotNull(), offered_why).when(none_offered, "nothing offered")
    share_why = F.when(deferred.isNull(), "deferral not recorded").when(offered_why.isNotNull(), offered_why).when(none_offered, "nothing offered")
    start = _suffix_start(n, w, deferred)
    refusal_why = (
        F.when(deferred.isNull(), "deferral not recorded").when(deferred == 0, "nothing deferred").when(offered_why.isNotNull(), offered_why)
        .when(F.col("cursor").isNull(), "cursor not recorded").when(F.col("cursor") >= n, "all recovered").when(start.isNull(), "no index fits")
    )
    reasons = {"floor_reason": floor_why, "deferred_reason": share_why, "refusal_reason": refusal_why}
    told = lambda reason, value: F.when(F.col(reason).isNull(), value)
    values = {"floor": told("floor_reason", F.try_divide("settled", "offered")), "deferred_share": told("deferred_reason", F.try_divide("deferred", "offered")), "first_refused": told("refusal_reason", start), "judged_share": F.try_divide("judged", "scored")}
    return rows.withColumns(reasons).withColumns(values)


# ---- answers, rejections, invariants


def answered_weight(answer: Column) -> Column:
    """The weight that an answer (VARIANT) gives: its ``noul`` if that is a finite number, else the share of ``true``, or of ``yes``, among its positive
    probabilities (even shares where none is positive); from 0 to 1. Null where it says neither."""
    number = lambda c: F.when(~F.schema_of_variant(c).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(c, "$", "double"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    shares = F.try_variant_get(answer, "$.probabilities", "map<string,variant>")
    positive = F.map_filter(F.transform_values(shares, lambda _, v: finite(number(v))), lambda _, v: v > 0)
    total = F.aggregate(F.map_values(positive), F.lit(0.0), lambda a, v: a + v)
    even = F.when(F.map_contains_key(shares, F.lit("true")) | F.map_contains_key(shares, F.lit("yes")), 1 / F.size(shares))
    mass = F.coalesce(F.try_element_at(positive, F.lit("true")), F.try_element_at(positive, F.lit("yes")))
    return clamp(F.coalesce(finite(number(at(answer, "$.noul"))), F.when(F.size(positive) > 0, mass / total).otherwise(even)))


def rejections(segments: DataFrame, scores: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """(session, anchor, idx): segments that the model's finite score into the anchor puts below the threshold. Other sources reject nothing."""
    judged = scores.where((F.col("source") == MODEL) & ~F.isnan("w") & (F.abs("w") < float("inf")) & (F.col("w") < threshold))
    into = judged.select("session", F.col("to_idx").alias("anchor"), F.col("from_idx").alias("idx")).distinct()
    return into.join(anchors.select("session", "anchor"), ["session", "anchor"], "left_semi").join(segments.select("session", "idx"), ["session", "idx"], "left_semi").select("session", "anchor", "idx")


def authored_lines(text: Column) -> Column:
    """How many headings of a delivered block are not those of quoted turns; blank and quoted lines are none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.startswith(s, F.lit("#")) & ~F.rlike(s, F.lit(QUOTED)))).cast("long")


def invariants(runs: DataFrame, session: DataFrame, control: DataFrame, injected_prefix: str) -> DataFrame:
    """(run, invariant, holds, found, wanted): five checks of each run (run, dropped, session_lines, control_lines, lane_calls).

    ``session`` (run, id, type, kind, text) and ``control`` (run, type) are the lines of its two streams. Provenance: no control record and
    no unknown kind in the session. Authorship: delivered blocks, by the prefix of their ids, have no headings but quoted ones. Ingestion: as
    many were dropped as were delivered. Evidence: as many lines as the run reported, of both streams together; it holds only if each agrees.
    Lane: its calls are in the control stream alone, at least one, and as many as expected unless ``lane_calls`` is null. A count that the run did
    not report is null, and its check does not hold.
    """
    block = F.coalesce(F.startswith("id", F.lit(injected_prefix)), F.lit(False))
    strange = F.coalesce(F.col("type").isin(*CONTROL), F.lit(False)) | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    said = session.groupBy("run").agg(F.count("*").alias("_lines"), F.count_if(strange).alias("_strange"), F.count_if(block).alias("_blocks"), F.coalesce(F.sum(F.when(block, authored_lines(F.col("text")))), F.lit(0)).alias("_authored"), F.count_if(F.col("type") == "s1_call").alias("_leaked"))
    kept = control.groupBy("run").agg(F.count("*").alias("_control"), F.count_if(F.col("type") == "s1_call").alias("_calls"))
    counts = ("_lines", "_strange", "_blocks", "_authored", "_leaked", "_control", "_calls")
    met = runs.join(said, "run", "left").join(kept, "run", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    c = {name: F.col(name) for name in counts}
    zero = F.lit(0).cast("long")
    agree = (F.col("session_lines") == c["_lines"]) & (F.col("control_lines") == c["_control"])
    lane = (c["_calls"] > 0) & (c["_leaked"] == 0) & (F.col("lane_calls").isNull() | (F.col("lane_calls") == c["_calls"]))
    checks = [
        ("provenance", c["_strange"] == 0, c["_strange"], zero),
        ("authorship", c["_authored"] == 0, c["_authored"], zero),
        ("ingestion", F.col("dropped") == c["_blocks"], c["_blocks"], F.col("dropped")),
        ("evidence", agree, c["_lines"] + c["_control"], F.col("session_lines") + F.col("control_lines")),
        ("lane", lane, c["_calls"], F.col("lane_calls")),
    ]
    rows = [F.struct(F.lit(name).alias("invariant"), F.coalesce(holds, F.lit(False)).alias("holds"), found.cast("long").alias("found"), wanted.cast("long").alias("wanted")) for name, holds, found, wanted in checks]
    return met.select("run", F.inline(F.array(*rows)))


def settled_by(scores: DataFrame) -> DataFrame:
    """(cell, settled, lane, fallback, other): distinct unordered pairs of (cell, from, to, source, pos), by the source of a pair's first row."""
    pair = F.struct(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"))
    first = scores.groupBy("cell", pair.alias("_p")).agg(F.min_by("source", "pos").alias("_s"))
    of = lambda s: F.count_if(F.col("_s") == s)
    return first.groupBy("cell").agg(F.count("*").alias("settled"), of(MODEL).alias("lane"), of(LOCAL).alias("fallback"), F.count_if(~F.coalesce(F.col("_s").isin(MODEL, LOCAL), F.lit(False))).alias("other"))
