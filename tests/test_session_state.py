"""Positions of segments in a stream that is stopped and goes on from a snapshot, against one pass over all rows."""

import random

from pyspark.sql import functions as F

from weftline.streaming.session_state import checked, placed, placed_at_once, snapshot

ROWS = "session long, id string, seq long, tokens long"


def rows_of():
    random.seed(6)
    out = [(s, f"m{random.randrange(30)}", q, random.randrange(50)) for s in range(4) for q in range(60)]
    return [r for r in out if r[2] < 30 or r[0] != 2]  # one session ends before the snapshot, one starts after it


def run(spark, tmp_path, name, batches, start=None):
    """The rows a stream of these batches gives, with the batch each came from."""
    source, got = tmp_path / f"{name}-in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = placed(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source)), start)

    def keep(df, batch):
        got.extend((*r, batch) for r in df.collect())

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"{name}-at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return got


def test_a_stream_goes_on_from_a_snapshot(spark, tmp_path):
    whole = rows_of()
    late = [(9, "first", 40, 1)]
    first, rest = [r for r in whole if r[2] < 33], [r for r in whole if r[2] >= 33] + late
    schema = "session long, id string, seq long, idx long, tokens long, fresh boolean, offered long, batch long"
    one = run(spark, tmp_path, "one", [[r for r in first if r[2] < 20], [r for r in first if r[2] >= 20]])
    cursors = spark.createDataFrame([(0, 4), (1, 99)], "session long, cursor long")
    taken = checked(snapshot(spark.createDataFrame(one, schema), cursors)).collect()
    assert {r.session: r.faults for r in taken} == {0: [], 1: ["cursor"], 2: [], 3: []}
    start = spark.createDataFrame(taken)
    two = run(spark, tmp_path, "two", [rest], start)
    got = {(r[0], r[1]): (r[3], r[6]) for r in one + two if r[5]}
    want = {(r.session, r.id): (r.idx, r.offered) for r in placed_at_once(spark.createDataFrame(whole + late, ROWS)).collect()}
    assert got == want and (9, "first") in got and len(got) == sum(r[5] for r in one + two)
    # known ids keep their places, and the next snapshot has the newest tokens of each
    assert all(got[r[0], r[1]][0] == r[3] for r in one + two)
    after = {r.session: r for r in checked(snapshot(spark.createDataFrame(two, schema), cursors, start)).collect()}
    newest = {}
    for s, i, _, tokens in sorted(whole + late, key=lambda r: r[2]):
        newest[s, i] = tokens
    assert {(s, x.id): x.tokens for s, r in after.items() for x in r.segments} == newest
    assert all([i for _, i in sorted((p, i) for (t, i), (p, _) in got.items() if t == s)] == r.order for s, r in after.items())


def test_snapshots_are_checked(spark):
    seg = lambda *ids: [(i, 1) for i in ids]
    rows = [
        (1, 2, ["a", "b"], seg("a", "b"), 1),
        (2, 1, ["a", "gone", "b", "a"], seg("a", "b", "c"), -3),
        (3, 7, ["a"], seg("a"), 1),
        (4, None, ["a"], seg("a"), 1),
        (5, 2, None, None, 5),
    ]
    df = spark.createDataFrame(rows, "session long, version int, order array<string>, segments array<struct<id: string, tokens: long>>, cursor long")
    got = {r.session: (r.order, len(r.segments), r.cursor, r.faults) for r in checked(df).collect()}
    assert got == {1: (["a", "b"], 2, 1, []), 2: (["a", "b"], 3, 0, ["order", "twice", "unplaced", "cursor"]), 3: ([], 0, 0, ["version"]), 4: ([], 0, 0, ["version"]), 5: ([], 0, 0, ["cursor"])}
    assert checked(df).select(F.max("version")).first()[0] == 2
