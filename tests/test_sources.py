"""Readers, tapes, policies, replay and streams on small files."""

import json

import pytest

TAPE = [
    {"schema": 1, "sessionId": "s", "systemPrompt": "be kind", "messages": [{"id": "a", "role": "user", "content": [{"type": "text", "text": "where is the river map"}]}]},
    {"kind": "wiring", "recall": {"w": 16}},
    {"messages": [{"id": "a", "role": "user", "content": [{"type": "text", "text": "where is the river map"}]}, {"role": "assistant", "content": [{"type": "thinking", "text": "the river map is here"}]}, {"role": "robot", "content": [{"type": "image"}]}]},
]


@pytest.fixture
def tape(spark, tmp_path):
    from weftline.sources.tape import read_tape

    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, TAPE)) + "\n")
    return read_tape(spark, str(tmp_path))


def test_tape(tape):
    from weftline.sources.tape import adapted, checked

    rows = tape.orderBy("line").collect()
    assert [(r.step, r.session, r.prompt, r.kind, r.fault) for r in rows] == [(1, "s", "be kind", None, None), (1, "s", "be kind", "wiring", None), (2, "s", "be kind", None, None)]
    seg = adapted(checked(tape)).where("step = 2").orderBy("seq").collect()
    assert [(r.id, r.kind, r.known) for r in seg] == [("a", "user", True), ("m1", "trace", True), ("m2", "systemPinned", False)]
    assert seg[2].text == '[image] {"type":"image"}'


def test_unfit_tapes(spark, tmp_path):
    from weftline.sources.tape import checked, read_tape

    (tmp_path / "t.jsonl").write_text('{"sessionId": "s", "messages": []}\n{"sessionId": "x", "messages": []}\n{"schema": 2, "messages": []}\n{"step": -1, "messages": []}\nnot json\n{"step": 3}\n')
    tape = read_tape(spark, str(tmp_path))
    assert [r.fault for r in tape.orderBy("line").collect()] == [None, "session changes", "schema is not 1", "step is negative", "no JSON", "messages is no array"]
    with pytest.raises(Exception, match="session changes|schema|negative|JSON|array"):
        checked(tape).collect()


def test_replay_digest_is_stable(tape):
    from weftline.plans.policy import PRESETS, layered
    from weftline.plans.replay import digest, records, state_proxy
    from weftline.sources.tape import adapted

    policy = layered(("preset", PRESETS["C2"]), ("profile", {"recall": {"threshold": 0.5}}))
    rows = records(tape, policy)
    assert {r.step: (r.segments, r.hits) for r in rows.collect()} == {1: (1, 0), 2: (3, 1)}
    assert digest(rows).collect() == digest(records(tape.repartition(3), policy)).collect()
    seg = adapted(tape).withColumnRenamed("seq", "idx")
    assert {r.step: r.proxy for r in state_proxy(seg, 40).collect()} == {2: "the river map is here"}


def test_logs(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from weftline.sources.logs import append_control, bad_lines, good_lines, read_lenient, read_strict, write_long_csv

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"type": "llm_call", "n": 1}\n{broken\n\n{"type": "assembly", "n": 2}\n')
    schema = StructType([StructField("type", StringType()), StructField("n", LongType())])
    rows = read_lenient(spark, str(tmp_path / "a"), schema)
    assert sorted(r.n for r in good_lines(rows).collect()) == [1, 2] and rows.count() == 3
    assert [r.head for r in bad_lines(spark, str(tmp_path / "a")).collect()] == ["{broken"]
    with pytest.raises(Exception):
        read_strict(spark, str(tmp_path / "a"), schema).collect()
    append_control(good_lines(rows), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="not a control record"):
        append_control(spark.createDataFrame([("user", 1)], schema), str(tmp_path / "c"))
    write_long_csv(spark.createDataFrame([('a "b", c', 1)], schema), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().type == 'a "b", c'


def test_zstd_frames(spark, tmp_path):
    import zstandard

    from weftline.sources.zstd_frames import read_lines

    one = zstandard.ZstdCompressor().compress
    skip = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    (tmp_path / "s.zstd").write_bytes(one(b"first\n") + skip + one(b"second\nthird") + one(b"lost")[:-2])
    rows = read_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.text for r in rows] == ["first", "second", "third"] and rows[0].unread > 0


def test_policy():
    from weftline.plans.policy import RULES, layered

    p = layered(("a", {"tail": {"k": 5}, "_note": "x", "recall": {"threshold": 2, "depth": 1.5}}), ("b", {"tail": {"k": 7}, "segmentation": {"chunkTokens": 64, "overlapTokens": 64}, "nothing": 1, "deliver": True}))
    assert p.values["tail.k"] == 7 and p.source["tail.k"] == "b" and p.values["recall.threshold"] == 0.55
    assert p.values["segmentation.chunkTokens"] == RULES["segmentation.chunkTokens"].default
    assert len(p.errors) == 4 and any("overrides a" in w for w in p.warnings)


def streamed(spark, tmp_path, schema, batches, build):
    """The rows that a stream of the batches, one file each, has given when it has read all."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr("* except (ts)", "timestamp_seconds(ts * 60) ts").coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
    read = spark.read.parquet(str(tmp_path / "in/b0")).schema
    source = spark.readStream.schema(read).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"got_{build.__name__}"
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_first_selection_as_a_stream(spark, tmp_path):
    from weftline.streaming.sessions import first_selection

    batches = [[(1, 5, 1), (1, 3, 1), (2, 9, 1)], [(1, 3, 2), (1, 1, 3)], [(3, 1, 300)], [(3, 1, 301)], [(2, 9, 302)]]
    got = streamed(spark, tmp_path, "session long, idx long, ts long", batches, first_selection)
    assert sorted((r.session, r.idx, r.place, r.updates) for r in got) == [(1, 1, 2, 2), (1, 3, 0, 1), (1, 5, 1, 1), (2, 9, 0, 1), (2, 9, 0, 1), (3, 1, 0, 1)]  # the state of 2 had gone


def test_deliveries_once_as_a_stream(spark, tmp_path):
    from weftline.streaming.sessions import once

    batches = [[(1, "a", 0), (1, "a", 1), (2, "a", 1)], [(1, "a", 4), (1, "b", 5)], [(1, "b", 6), (1, "c", 6)]]
    got = streamed(spark, tmp_path, "session long, payload string, ts long", batches, once)
    assert sorted((r.session, r.payload) for r in got) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_late_rows_of_a_stream_are_not_counted(spark, tmp_path):
    from weftline.streaming.sessions import activity

    # the fourth batch is hours behind the second, whose watermark ends the first window (late rows are told by the watermark one batch ago)
    batches = [[("x", 1.0, 5), ("y", 2.0, 6), ("x", 3.0, 7)], [("x", 1.0, 200)], [("x", 1.0, 201)], [("x", 9.0, 8)], [("x", 1.0, 400)]]
    got = streamed(spark, tmp_path, "event_type string, value double, ts long", batches, activity)
    assert sorted((r.event_type, r.n, r.total) for r in got if r.start.hour == 0) == [("x", 2, 4.0), ("y", 1, 2.0)]


def test_activity_of_a_table(spark):
    from weftline.streaming.sessions import activity

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    assert activity(events).agg({"n": "sum"}).first()[0] == events.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'recall_tree' in names and not [n for n in names if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
