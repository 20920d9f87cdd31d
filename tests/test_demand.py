"""Walks that score their own rows against plain walks over all scores, and sweeps against the rule one row at a time."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import demand, pairs, recall
from weftline.operators.scorers import LEXICAL, LOCAL, MODEL, Scorer

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def talk(spark):
    random.seed(4)
    rows = [(s, i, i * 1000, " ".join(random.choices(WORDS, k=random.choice([1, 2, 3])))) for s in range(5) for i in range([1, 2, 30, 40, 25][s])]
    return spark.createDataFrame(rows, "session long, idx long, ts long, text string")


def seeds_of(talk):
    return talk.groupBy("session").agg(F.max("idx").alias("seed"), F.max("ts").alias("now"))


def none(spark):
    return spark.createDataFrame([], "session long, from_idx long, to_idx long, w double, source string, at long")


@pytest.mark.parametrize("scale", [40_000.0])
def test_demand_finds_what_recall_finds(spark, talk, scale):
    seeds = seeds_of(talk)
    scores = pairs.lexical_scores(talk, 6).join(talk.select("session", F.col("idx").alias("to_idx"), F.col("ts").alias("at")), ["session", "to_idx"])
    want = recall.recall(seeds, recall.walkable(scores, seeds, 0.4, scale), 3).collect()
    got = demand.recall_demand(talk, seeds, none(spark), LEXICAL, 0.4, 3, window=6, scale=scale)
    key = lambda r: (r.session, r.idx, r.depth, r.via, r.pos, round(r.w, 9))
    assert sorted(map(key, got.hits.collect())) == sorted(map(key, want)) and len(want) > 10
    # only rows that were reached are paid for, and a second walk finds everything scored
    sessions = {r.session: r for r in got.sessions.collect()}
    assert all(r.judged == 0 and r.missed == 0 for r in sessions.values()) and sessions[0].pairs == 0 and sessions[0].stop == "complete"
    again = demand.recall_demand(talk, seeds, got.scores, LEXICAL, 0.4, 3, window=6, scale=scale)
    assert sorted(map(key, again.hits.collect())) == sorted(map(key, want)) and again.levels.where("pairs > 0").isEmpty()


def test_a_model_is_asked_again_for_what_was_guessed(spark, talk):
    seeds = seeds_of(talk)
    model = Scorer(MODEL, LEXICAL.features, LEXICAL.score)
    guessed = pairs.lexical_scores(talk, 6).withColumn("w", F.lit(0.9)).withColumn("at", F.lit(0).cast("long"))
    local = demand.recall_demand(talk, seeds, guessed, LEXICAL, 0.4, 3, window=6)
    asked = demand.recall_demand(talk, seeds, guessed, model, 0.4, 3, window=6)
    assert local.levels.where("pairs > 0").isEmpty() and asked.sessions.agg(F.sum("judged")).first()[0] > 0
    # a model that gives no answer costs reach, and what was guessed before still leads on
    mute = Scorer(MODEL, LEXICAL.features, lambda p: p.withColumn("w", F.lit(float("nan"))))
    missed = demand.recall_demand(talk, seeds, guessed, mute, 0.4, 3, window=6)
    row = lambda d: sorted((r.session, r.idx, r.depth) for r in d.hits.collect())
    assert row(missed) == row(local) and missed.scores.isEmpty()
    first = missed.levels.where("depth = 0 AND session = 2").first()
    assert (first.rows, first.pairs, first.missed, first.missed_pairs, first.judged) == (1, 6, 1, 6, 0)


def test_budget_depth_and_held_rows(spark, talk):
    seeds = seeds_of(talk)
    stop = lambda **x: {r.session: (r.stop, r.pairs) for r in demand.recall_demand(talk, seeds, none(spark), LEXICAL, 0.0, x.pop("depth", 4), window=6, **x).sessions.collect()}
    assert stop(max_pairs=6)[3] == ("budget", 6) and stop(depth=1)[3] == ("depth", 6)
    held = seeds.select("session", F.col("seed").alias("idx"))
    kept = demand.recall_demand(talk, seeds, none(spark), LEXICAL, 0.0, 4, window=6, held=held)
    assert kept.hits.isEmpty() and {(r.session, r.skipped, r.rows) for r in kept.levels.collect()} == {(s, 1, 0) for s in (1, 2, 3, 4)}


def swept(rows, window, most, settled, anchor, refused, answered):
    """The rule, one row after another: scored, judged, deferred pairs and rows."""
    order = [i for i in rows if i not in settled and i > 0]
    if anchor in order:
        order = [anchor, *[i for i in order if i != anchor]]
    size = lambda i: min(i, window)
    scored = judged = 0
    for at, i in enumerate(order):
        if (scored and most is not None and scored + size(i) > most) or i in refused:
            late = [j for j in order[at:] if j >= i]
            return scored, judged, sum(map(size, late)), len(late)
        scored, judged = scored + size(i), judged + size(i) * (i in answered)
    return scored, judged, 0, 0


@pytest.mark.parametrize("most", [None, 1, 5, 23, 60])
@pytest.mark.parametrize("anchored", [False, True])
def test_sweep(spark, most, anchored):
    random.seed(8)
    lengths = [1, 2, 9, 30, 31, 12]
    seg = spark.createDataFrame([(s, i, 0, "aa bb") for s, n in enumerate(lengths) for i in range(n)], "session long, idx long, ts long, text string")
    pick = lambda share: {s: {i for i in range(n) if random.random() < share} for s, n in enumerate(lengths)}
    settled, refused, answered = pick(0.2), pick(0.05), pick(0.7)
    flat = lambda d: spark.createDataFrame([(s, i) for s, xs in d.items() for i in xs], "session long, idx long")
    yes = flat(answered).select("session", F.col("idx").alias("to_idx"), F.lit(0.5).alias("w"))
    no = flat(refused).select("session", F.col("idx").alias("to_idx"), F.lit(True).alias("refused"))
    model = Scorer(MODEL, lambda: [], lambda p: p.join(yes, ["session", "to_idx"], "left").join(no, ["session", "to_idx"], "left"))
    anchors = {s: max(0, n - 3) for s, n in enumerate(lengths)}
    got = demand.sweep(seg, model, 0.6, 8, most, flat(settled), flat({s: {i} for s, i in anchors.items()}) if anchored else None)
    counters = {r.session: r for r in got.sessions.collect()}
    for s, n in enumerate(lengths):
        want = swept(range(n), 8, most, settled[s], anchors[s] if anchored else -1, refused[s], answered[s])
        r = counters[s]
        assert (r.scored_pairs, r.judged_pairs, r.deferred_pairs, r.deferred_segments) == want
        # the local stand-in says 1 for equal texts, the model 0.5
        assert r.edges == r.scored_pairs - r.judged_pairs
    assert {r[0] for r in got.scores.select("source").distinct().collect()} <= {MODEL, LOCAL}


def test_bands_hold_every_pair_of_a_window(spark):
    seg = spark.range(100).select((F.col("id") % 2).alias("session"), F.floor(F.col("id") / 2).alias("idx"))
    for w in (1, 3, 16, 64):
        got = {(r.session, r.from_idx, r.to_idx) for r in pairs.candidates(seg, [], w).collect()}
        assert got == {(s, a, b) for s in (0, 1) for b in range(50) for a in range(max(0, b - w), b)}
