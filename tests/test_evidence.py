"""What runs leave behind, by hand: manifests, stores, windows, lanes, coverage, invariants, plans; and matrices against their cells."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import evidence, matrix, planning


def parsed(spark, rows, name="record"):
    return spark.createDataFrame([(c, p, r if isinstance(r, str) else json.dumps(r)) for c, p, r in rows], "cell string, pos long, t string").select("cell", "pos", F.try_parse_json("t").alias(name))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_run_identity_names_the_first_reason(spark):
    full = {"version": "1", "executable": "", "command": "", "probedAt": "t", "model": {"provider": "p", "model": 3}}
    texts = {"a": None, "b": "{", "c": "null", "d": json.dumps({"_host": 5}), "e": json.dumps({"_host": {"version": 1}}), "f": json.dumps({"_host": []}), "g": json.dumps({"_host": full}), "h": ""}
    got = by(evidence.run_identity(spark.createDataFrame(list(texts.items()), "run string, text string")), "run")
    assert {k: r.reason for k, r in got.items()} == {"a": "no manifest", "b": "no JSON", "c": "no block", "d": "no block", "e": "no version", "f": "no version", "g": None, "h": "no JSON"}
    assert got["g"][3:] == ("1", None, "", "t", "p", None) and got["e"][3:] == (None,) * 6


def test_stores_by_turns_then_bytes_then_path(spark):
    stores = spark.createDataFrame([("a", "x", 1), ("a", "y", 9), ("a", "z", 9), ("a", "stub", 99), ("b", "only", 3)], "cell string, path string, bytes long")
    events = spark.createDataFrame([("a", p, "turn/start") for p in "xyz"] + [("a", "stub", "step/start"), ("b", "only", None), ("c", "x", "turn/start")], "cell string, path string, type string")
    got = {(r.cell, r.path): r.role for r in evidence.store_roles(stores, events).collect()}
    assert got == {("a", "x"): "ignored", ("a", "y"): "primary", ("a", "z"): "ignored", ("a", "stub"): "stub", ("b", "only"): "never ran"}


def test_snapshots_of_other_sessions_are_not_taken(spark):
    cells = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), ("d", "s"), ("e", None)], "cell string, session string")
    snaps = [("a", "p1", "s", None), ("a", "p2", "s", 4), ("a", "p0", "t", 9), ("b", "q", "s", None), ("c", "r", "t", 1), ("e", "u", None, 1)]
    got = by(evidence.chosen_snapshots(cells, spark.createDataFrame(snaps, "cell string, path string, session string, judged long")), "cell")
    assert {k: tuple(r)[1:] for k, r in got.items()} == {"a": ("p2", 2, 3, "several"), "b": ("q", 1, 1, None), "c": (None, 0, 1, "other sessions"), "d": (None, 0, 0, "no snapshots"), "e": (None, 0, 1, "other sessions")}


def test_windows_must_agree(spark):
    records = [
        ("a", 1, {"kind": "tuning-file", "effective": {"window": "16"}}), ("a", 0, {"kind": "wiring", "recall": {"w": 16.7}}), ("a", 2, {"kind": "wiring", "recall": {"w": -1}}),
        ("b", 0, {"kind": "wiring", "recall": {"w": 8}}), ("c", 0, {"kind": "other", "recall": {"w": 8}}), ("c", 1, {"kind": "wiring", "recall": "w"}), ("c", 2, "[]"), ("e", 0, {"kind": "wiring", "recall": {"w": "wide"}}),
    ]
    edges = spark.createDataFrame([("b", "window:9;s1"), ("b", "window:8;s1"), ("d", "x;window:4"), ("d", "xwindow:5"), ("d", None), ("c", "window:0;")], "cell string, provenance string")
    cells = spark.createDataFrame([(c,) for c in "abcde"], "cell string")
    got = by(evidence.window_evidence(cells, parsed(spark, records), edges), "cell")
    assert {k: tuple(r)[1:] for k, r in got.items()} == {
        "a": (16, "wiring", [16], None), "b": (None, None, [8, 9], "records disagree"), "c": (None, None, [], "no window recorded"), "d": (4, "edges", [4], None), "e": (None, None, [], "no window recorded"),
    }


def test_lane_by_authority(spark):
    wiring = lambda **kw: {"kind": "wiring", **kw}
    tuning = lambda p: {"kind": "tuning-file", "effective": {"provider": p}}
    records = [
        ("none", 0, wiring(s1="none", configuredProvider="none")), ("demoted", 0, wiring(recall={})), ("demoted", 1, wiring(s1="none", configuredProvider="local", conflicts=["x"])), ("demoted", 2, wiring(s1={"provider": "p"})),
        ("inside", 0, wiring(s1={"provider": "none"}, configuredProvider="q", conflicts=5)), ("mode", 0, wiring(s1={"provider": "p", "mode": "none"})), ("on", 1, wiring(s1={"mode": "http"})), ("on", 0, tuning("none")),
        ("strange", 0, wiring(s1=None)), ("strange", 1, tuning("p")), ("before", 0, tuning("none")), ("before", 1, wiring(s1=4, configuredProvider="p")), ("tuned", 3, tuning("b")), ("tuned", 4, tuning("none")),
    ]
    calls = spark.createDataFrame([("called", 0, None), ("called", 1, "none"), ("bare", 0, None), ("tuned", 0, "c")], "cell string, pos long, provider string")
    names = ["none", "demoted", "inside", "mode", "on", "strange", "before", "tuned", "called", "bare", "silent"]
    got = by(evidence.lane_state(spark.createDataFrame([(c,) for c in names], "cell string"), parsed(spark, records), calls), "cell")
    assert {k: tuple(r)[1:] for k, r in got.items()} == {
        "none": ("none", "none", "none", None, "wiring"), "demoted": ("demoted", "none", "local", 1, "wiring"), "inside": ("demoted", "none", "q", None, "wiring"), "mode": ("none", "p", None, None, "wiring"),
        "on": ("present", None, None, None, "wiring"), "strange": ("unknown", None, None, None, "wiring"), "before": ("demoted", "none", "p", None, "wiring"), "tuned": ("present", "b", None, None, "tuning"),
        "called": ("none", "none", None, None, "calls"), "bare": ("present", None, None, None, "calls"), "silent": ("unknown", None, None, None, "silence"),
    }


def test_closed_forms_equal_sums(spark):
    cases = [(n, w, d) for n in range(0, 9) for w in range(1, 7) for d in range(0, 24)]
    rows = spark.createDataFrame(cases, "segments long, window long, deferred long").select("*", *[F.lit(v).alias(k) for k, v in {"state": "present", "window_reason": None, "calls": 1, "settled": 1, "cursor": -1, "scored": 0, "judged": 0}.items()])
    for r in evidence.coverage(rows).collect():
        each = [min(i, r.window) for i in range(r.segments)]
        starts = [k for k in range(1, r.segments) if sum(each[k:]) == r.deferred]
        wanted = max(starts) if starts and r.deferred else None
        assert (r.offered, r.first_refused) == (sum(each), wanted), r
        assert r.refusal_reason == (None if wanted else "nothing deferred" if not r.deferred else "no index fits")
        assert r.floor == (1 / r.offered if r.offered else None) and r.judged_share is None


def test_first_refusals_of_long_orders(spark):
    n, w = 10**9, 100_000
    total = w * (w + 1) // 2 + (n - 1 - w) * w
    starts = [1, 2, 77, w - 1, w, w + 1, n - 1]
    deferred = [total - k * (k - 1) // 2 if k <= w + 1 else (n - k) * w for k in starts]
    rows = spark.createDataFrame([(k, n, w, d) for k, d in zip(starts, deferred, strict=True)], "k long, segments long, window long, deferred long")
    full = rows.select("*", *[F.lit(v).alias(k) for k, v in {"state": "none", "window_reason": None, "calls": 0, "settled": 1, "cursor": 0, "scored": 2, "judged": 1}.items()])
    got = evidence.coverage(full).collect()
    assert [(r.first_refused, r.offered, r.lane, r.floor, r.floor_reason, r.judged_share) for r in got] == [(r.k, total, "absent", None, "lane absent", 0.5) for r in got]


@pytest.mark.parametrize(
    ("row", "floor", "share", "refusal"),
    [
        (dict(settled=None), "no scores recorded", None, None),
        (dict(segments=None), "no order recorded", "no order recorded", "no order recorded"),
        (dict(window=None, window_reason="records disagree"), "records disagree", "records disagree", "records disagree"),
        (dict(window=None), "no window recorded", "no window recorded", "no window recorded"),
        (dict(segments=1), "nothing offered", "nothing offered", "no index fits"),
        (dict(deferred=None), None, "deferral not recorded", "deferral not recorded"),
        (dict(deferred=0, cursor=None), None, None, "nothing deferred"),
        (dict(cursor=None), None, None, "cursor not recorded"),
        (dict(cursor=9), None, None, "all recovered"),
        (dict(deferred=10**6), None, None, "no index fits"),
        (dict(state="demoted"), "lane demoted", None, None),
        (dict(state="unknown", calls=0), "lane absent", None, None),
        (dict(state="unknown"), None, None, None),
    ],
)
def test_reasons_of_coverage(spark, row, floor, share, refusal):
    schema = "state string, calls long, segments long, window long, window_reason string, settled long, deferred long, cursor long, scored long, judged long"
    base = dict(state="present", calls=1, segments=9, window=3, window_reason=None, settled=5, deferred=6, cursor=0, scored=5, judged=2)
    got = evidence.coverage(spark.createDataFrame([{**base, **row}], schema)).collect()[0]
    assert (got.floor_reason, got.deferred_reason, got.refusal_reason) == (floor, share, refusal)
    assert (got.floor is None, got.deferred_share is None, got.first_refused is None) == tuple(x is not None for x in (floor, share, refusal))


def test_answers(spark):
    answers = [({"noul": 2}, 1.0), ({"noul": -1, "probabilities": {"true": 1}}, 0.0), ({"noul": "1", "probabilities": {"true": 1, "yes": 3}}, 0.25), ({"probabilities": {"yes": 0, "x": -1}}, 0.5), ({"probabilities": {"yes": 0, "x": 1}}, None), ({"probabilities": {}}, None), ({"noul": True}, None), ([], None), ("null", None)]
    rows = [("a", i, a) for i, (a, _) in enumerate(answers)]
    got = parsed(spark, rows, "answer").orderBy("pos").select(evidence.answered_weight(F.col("answer")).alias("w")).collect()
    assert [r.w for r in got] == [w for _, w in answers]


def test_rejections_are_the_models_alone(spark):
    seg = spark.createDataFrame([(1, i) for i in range(4)], "session long, idx long")
    rows = [(1, 0, 3, 0.1, "s1-noul"), (1, 0, 3, 0.2, "s1-noul"), (1, 1, 3, 0.1, "lexical"), (1, 2, 3, float("nan"), "s1-noul"), (1, 1, 2, 0.0, "s1-noul"), (1, 9, 3, 0.0, "s1-noul"), (1, 2, 3, None, "s1-noul"), (2, 0, 3, 0.0, "s1-noul"), (1, 2, 3, 0.5, "s1-noul")]
    scores = spark.createDataFrame(rows, "session long, from_idx long, to_idx long, w double, source string")
    anchors = spark.createDataFrame([(1, 3), (2, 3)], "session long, anchor long")
    assert [tuple(r) for r in evidence.rejections(seg, scores, anchors, 0.5).collect()] == [(1, 3, 0)]


def test_settled_pairs_count_once(spark):
    rows = [("a", 1, 2, "lexical", 1), ("a", 2, 1, "s1-noul", 0), ("a", 1, 3, "lexical", 0), ("a", 1, 4, None, 0), ("a", 4, 5, "odd", 0)]
    got = evidence.settled_by(spark.createDataFrame(rows, "cell string, from long, to long, source string, pos long")).collect()
    assert [tuple(r) for r in got] == [("a", 4, 1, 1, 2)]


def test_invariants(spark):
    quoted = "## earlier toolResult turn, quoted verbatim · m4\nsaid\r\n\r\n # not a heading"
    lines = [("ok", "in-1", "user/message", "user", quoted), ("ok", "m", None, "trace", "# free"), ("bad", "in-1", "s1_call", "user", "## earlier robot turn, quoted verbatim · m\n# own"), ("bad", None, "x", None, None)]
    session = spark.createDataFrame(lines, "run string, id string, type string, kind string, text string")
    control = spark.createDataFrame([("ok", "s1_call"), ("ok", None), ("bad", "s1_call")], "run string, type string")
    runs = spark.createDataFrame([("ok", 1, 2, 2, 1), ("bad", None, 2, 2, None), ("empty", 0, 0, 0, None)], "run string, dropped long, session_lines long, control_lines long, lane_calls long")
    got = {(r.run, r.invariant): (r.holds, r.found, r.wanted) for r in evidence.invariants(runs, session, control, "in-").collect()}
    names = ("provenance", "authorship", "ingestion", "evidence", "lane")
    assert [got["ok", n] for n in names] == [(True, 0, 0), (True, 0, 0), (True, 1, 1), (True, 4, 4), (True, 1, 1)]
    assert [got["bad", n] for n in names] == [(False, 2, 0), (False, 2, 0), (False, 1, None), (False, 3, 4), (False, 1, None)]
    assert [got["empty", n][0] for n in names] == [True, True, True, True, False]


def test_plans_and_todos(spark):
    text = "so - no\n1. first \r\n  2) second\n- \n-third\n* " + "x" * 500 + "\n+ fourth"
    got = planning.stated_plans(spark.createDataFrame([(1, text), (2, None), (3, "")], "n long, text string"), "n").orderBy("step").collect()
    assert [(r.id, r.step, r.summary[:8], len(r.summary)) for r in got] == [("p1", 1, "first", 5), ("p2", 2, "second", 6), ("p3", 3, "xxxxxxxx", 403)]
    items = [{"content": "done", "status": "completed"}, {"content": " go ", "status": "pending"}, {"content": 5, "status": "pending"}, "x", {"content": "odd", "status": "odd"}, {"content": " ", "status": "pending"}, {"content": "on", "status": "in_progress"}]
    events = [("a", 0, {"type": "todo/write", "data": {"todos": items}}), ("b", 0, {"type": "todo/read", "data": {"todos": items}}), ("c", 0, {"type": "todo/write", "data": {"todos": "none"}}), ("d", 0, {"type": "todo/write", "data": {"todos": [1]}})]
    lists = planning.todos(parsed(spark, events, "event"), "cell")
    assert [(r.cell, len(r["items"])) for r in lists.collect()] == [("a", 4)]
    assert [(r.cell, r.step, r.summary) for r in planning.open_todos(lists, "cell").orderBy("step").collect()] == [("a", 1, "go"), ("a", 2, "on")]


@pytest.mark.parametrize(("window", "height", "width"), [(3, 4, 5), (1, 1, 1), (50, 7, 3)])
def test_matrices_equal_their_cells(spark, window, height, width):
    seg = spark.range(0, 60).select((F.col("id") % 2).alias("session"), F.floor(F.col("id") / 2).alias("idx")).union(spark.createDataFrame([(7, 0)], "session long, idx long"))
    asked = seg.where("(idx * 7 + session) % 3 = 0")
    cells = matrix.activity(seg, asked, window)
    counts = {(r.session, r.state): r.n for r in matrix.activity_counts(seg, asked, window).collect()}
    assert counts == {(r.session, r.state): r["count"] for r in cells.groupBy("session", "state").count().collect()}
    strength = {"absent": 0, "existed": 1, "candidate": 2, "root": 3}
    wanted = {}
    for c in cells.collect():
        key = (c.session, c.idx // height, c.invocation // width)
        state, n = wanted.get(key, ("absent", 0))
        wanted[key] = (max(state, c.state, key=strength.get), n + 1)
    assert {(r.session, r.row, r.col): (r.state, r.cells) for r in matrix.tiles(seg, asked, window, height, width).collect()} == wanted
