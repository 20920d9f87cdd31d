"""What is moved: pairs stay with their sessions, and marks of a context are moved once."""

import random

from pyspark.sql import functions as F

from weftline.operators import assembly, pairs


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ")


def segments(spark, session="session"):
    random.seed(3)
    rows = [(s, i, 10 * i, f"w{i % 3} w{i % 5}", 1 + i % 4) for s in range(4) for i in random.sample(range(60), 45)]
    return spark.createDataFrame(rows, "session long, idx long, ts long, text string, tokens long")


def test_pairs_are_made_without_a_shuffle_of_pairs(spark):
    seg = segments(spark)
    assert exchanges(pairs.candidates(seg, ["ts"])) == 1
    want = {(a.session, a.idx, b.idx) for a in seg.collect() for b in seg.collect() if a.session == b.session and b.idx - 7 <= a.idx < b.idx}
    assert {(r.session, r.from_idx, r.to_idx) for r in pairs.candidates(seg, [], 7).collect()} == want
    asked = seg.where("idx % 9 = 0").select("session", F.col("idx").alias("to_idx"), (F.col("idx") * 2).alias("n"))
    got = pairs.candidates(seg, ["ts"], 7, asked).collect()
    assert {(r.session, r.from_idx, r.to_idx) for r in got} == {x for x in want if x[2] % 9 == 0} and all(r.n == 2 * r.to_idx and r.b.ts == 10 * r.to_idx for r in got)


def test_settled_is_one_shuffle_by_session(spark):
    rows = [(1, 5, 3, "s1-noul", 1.0), (1, 3, 5, "lexical", 0.5), (1, 2, 3, "s1-noul", 2.0), (1, 2, 3, "lexical", 2.5), (2, 0, 1, "other", 0.0), (2, 0, 1, "lexical", None), (2, 0, 2, "lexical", 7.0)]
    log = spark.createDataFrame(rows, "session long, from_idx long, to_idx long, source string, pos double")
    assert {tuple(r) for r in pairs.settled(log).collect()} == {(1, 2, 1, 1), (2, 2, 0, 1)}
    assert exchanges(pairs.settled(log.repartition(4, "session"))) == 1


def chosen(placed, hits, judged, window):
    """The rule, session by session."""
    out = set()
    for s in {r[0] for r in placed}:
        free = {i: t for q, i, t, p in placed if q == s and p == "history"}
        seed = max((i for q, i, t, p in placed if q == s and p == "anchor"), default=None)
        walked = [i for q, i in hits if q == s]
        found = [i for i in walked if i in free]
        near = [i for i in free if seed is not None and not walked and seed - window <= i < seed and (s, i, seed) not in judged]
        told = [(i, "recalled") for i in found] if found else [(i, "unjudged") for i in near] if near else [(i, "recency") for i in free]
        out |= {(s, i, free[i], why) for i, why in told}
    return out


def test_selected_against_the_rule(spark):
    random.seed(5)
    placed, hits, judged = [], [], set()
    for s in range(40):
        n = random.choice([1, 3, 9, 20])
        for i in range(n):
            place = "anchor" if i == n - 1 and s % 7 else "tail" if i >= n - 3 else random.choice(["history", "history", "pinned"])
            placed.append((s, i, i + 1, place))
        hits += [(s, i) for i in range(n) if s % 3 == 0 and random.random() < 0.3]
        judged |= {(s, i, random.choice([n - 1, n - 2])) for i in range(n - 2) if s % 2 or random.random() < 0.5}
    p = spark.createDataFrame(placed, "session long, idx long, tokens long, place string")
    h = spark.createDataFrame(hits, "session long, idx long")
    j = spark.createDataFrame([(*x, "s1-noul") for x in judged] + [(s, 0, n, "lexical") for s in range(40) for n in (8, 19)], "session long, from_idx long, to_idx long, source string")
    got = [tuple(r) for r in assembly.selected(p, h, j, 6).collect()]
    want = chosen(placed, hits, judged, 6)
    assert len(got) == len(set(got)) and set(got) == want and {w[3] for w in want} == {"recalled", "unjudged", "recency"}


def test_chunks_move_no_row(spark):
    from weftline.operators.chunker import chunked

    rows = spark.createDataFrame([(1, "one. " * 40 + "\n\n- a\n- b"), (2, "short"), (3, None)], "id long, text string")
    got = chunked(rows, "id", "text", 16, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1
    assert {r.chunk_id: r.text for r in got.collect() if r.chunk_of is None} == {"2": "short"}


def test_costs_of_wide_and_other_characters():
    from weftline.operators.chunker import Costs, quarters

    for text in ("", "abc", "é–𝄞", "a一b二", "一" * 9 + "x"):
        cost = [4 if c in "一二" else 1 for c in text]
        assert [*Costs(text).upto] == [sum(cost[:i]) for i in range(len(text) + 1)] and quarters(text) == sum(cost)
