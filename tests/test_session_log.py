"""Mixed session logs, system prompts and milestones by hand."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import milestones, session_log


def lines(spark, *values):
    rows = [(1, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return session_log.session_events(spark.createDataFrame(rows, "session long, pos long, value string"))


def test_shapes_of_events(spark):
    long = "x" * 2100
    events = lines(
        spark,
        {"type": "user/message", "seq": 7, "data": {"id": "u", "role": "user", "content": [{"type": "text", "text": " hi "}, "there", 5, {"type": "image", "url": "z"}], "source": {"kind": "cli"}}},
        {"type": "assistant/message", "data": {"message": {"role": "assistant", "content": [{"type": "thinking", "text": "hm"}]}}},
        {"type": "tool/call", "data": {"callId": "c", "name": "bash", "arguments": {"b": 1, "a": [2]}}},
        {"type": "tool/call", "data": {"arguments": long}},
        {"type": "tool/result", "data": {"message": {"role": "tool", "toolCallId": "c", "isError": True, "content": "plain"}}},
        {"type": "tool/result", "data": {"message": {"role": "tool", "toolCallId": 5, "isError": "no", "content": [""]}}},
        {"type": "step/start", "data": {"message": {"role": "user", "content": "not said"}}},
        {"type": "user/message", "data": {"turn": 1}},
        {"data": {"message": {"content": "no role"}}},
        '{"type": "user/mess',
        "   ",
        "[1, 2]",
        "null",
    )
    got = session_log.adapted(events).orderBy("pos").collect()
    assert [r.outcome for r in got] == ["segment"] * 5 + ["empty", "lifecycle", "lifecycle", "segment", "bad line", "lifecycle", "lifecycle"]
    first, thought, call, unnamed, result, _, _, _, strange, *_ = got
    assert (first.id, first.seq, first.kind, first.text, first.task_tag) == ("u", 7, "user", 'hi \nthere\n[image] {"type":"image","url":"z"}', "cli")
    assert (thought.kind, thought.role, thought.seq, thought.id) == ("trace", "assistant", 1, "m0")
    assert (call.id, call.kind, call.text) == ("c", "toolCall", 'tool call: bash\n{"a":[2],"b":1}')
    assert (unnamed.id, unnamed.text) == ("toolcall-3", "tool call: (unnamed)\n" + "x" * 2000 + "…")
    assert (result.call_id, result.tool_error, result.text) == ("c", True, "plain") and (strange.kind, strange.role) == ("systemPinned", "")
    counts = session_log.report(session_log.adapted(events), "session").first()
    assert tuple(counts) == (1, 12, 6, 1, 4, 1, 1)


def test_calls_meet_their_results_by_id(spark):
    rows = [(1, 0, "toolCall", "a", None), (1, 1, "toolCall", "b", None), (1, 2, "toolResult", "r", "a"), (1, 3, "toolResult", "r", "b"), (1, 4, "toolResult", "r", "a"), (1, 5, "toolCall", "a", None), (1, 6, "toolResult", "r", None), (1, 7, "toolResult", "r", "z"), (1, 8, "toolResult", "r", "a")]
    got = session_log.paired_calls(spark.createDataFrame(rows, "session long, pos long, kind string, id string, call_id string")).collect()
    assert {(r.call_id, r.call_pos, r.result_pos) for r in got} == {("a", 0, 2), ("b", 1, 3), ("a", 5, 8), ("z", None, 7), (None, None, 6)}


def said(text, role="system"):
    return {"role": role, "content": [{"type": "text", "text": text}]}


@pytest.mark.parametrize(
    ("event", "want"),
    [
        (said(" x "), "x"),
        ({"data": said("y", "developer")}, "y"),
        ({"data": {"message": said("deep")}, "payload": said("near")}, "near"),
        ({"payload": said("third"), "message": said("first"), "data": said("second")}, "first"),
        ({"message": said("", "system"), "data": said("second")}, "second"),
        ({"data": {"data": {"data": said("too deep")}}}, None),
        (said("user", "user"), None),
        ({"role": "system", "content": "no parts"}, None),
        ({"role": "system", "content": [], "payload": {"message": said("below")}}, "below"),
        ([1], None),
    ],
)
def test_system_prompt(spark, event, want):
    assert spark.range(1).select(session_log.system_prompt(F.parse_json(F.lit(json.dumps(event))))).first()[0] == want


def test_milestones(spark):
    call = lambda name, **args: f"tool call: {name}\n{json.dumps(args)}"
    rows = [
        ("user", "fix it", "u", None, None),
        ("trace", "hm\nRoot cause is A\nRoot cause: B", "t", None, None),
        ("toolCall", call("bash", command="npm test"), "c1", None, None),
        ("toolResult", "1 failed", "r", "c1", False),
        ("toolCall", call("edit", file_path="f.py"), "c2", None, None),
        ("toolCall", call("bash", command="pytest a"), "c3", None, None),
        ("toolResult", "3 passed\nx\nFAILED y\n4 errors", "r", "c3", True),  # before the edit's result: void
        ("toolResult", "has been updated", "r", "c2", None),
        *[x for i in range(4) for x in [("toolCall", call("bash", command=f"pytest {i}"), f"d{i}", None, None), ("toolResult", f"{i} passed", "r", f"d{i}", i == 2)]],
        ("toolCall", call("bash", command="pytest 0"), "e", None, None),
        ("toolResult", "9 failed", "r", "e", False),
        ("assistant", "caused by nothing", "a", None, None),
        ("assistant", "just planning", "a", None, None),
        ("toolResult", "5 passed", "r", "lost", False),
    ]
    seg = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)] + [(2, 0, "user", "quiet", "u", None, None)], "session long, idx long, kind string, text string, id string, call_id string, tool_error boolean")
    anchors = spark.createDataFrame([(1, 0), (2, 0)], "session long, idx long")
    got = {r.session: r for r in milestones.milestones(seg, anchors, 1000).collect()}
    one = got[1]
    assert one.diagnosis == "caused by nothing" and one.change == "f.py\nhas been updated"
    assert one.checks == ["pytest 2\n2 passed\n[tool reported an error]", "pytest 3\n3 passed", "pytest 0\n9 failed"]
    assert one.text.startswith("<task_progress>\nFinding (model statement):\ncaused by nothing\n\nLatest write/edit result:\nf.py") and one.text.endswith("pytest 0\n9 failed\n</task_progress>")
    assert (got[2].text, got[2].checks) == (None, [])
    assert {len(r.text) for r in milestones.milestones(seg, anchors, 60).collect() if r.text} == {60}
    assert [r.text for r in milestones.milestones(seg, anchors, 33).collect() if r.session == 1] == [""]
