"""Containment against comparing all pairs, and delivery against the rule one segment at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.grams import TIERS, minimisers
from weftline.operators import assembly
from weftline.operators.containment import contained


def test_containment_equals_all_pairs(spark):
    random.seed(2)
    text = lambda n: "".join(random.choice("ab c é\n") for _ in range(n))
    hays = [(g, i, text(random.choice([0, 1, 5, 40, 300, 900]))) for g in range(3) for i in range(25)]
    needles = []
    for g, i, t in hays:
        for k in range(3):
            a = random.randrange(len(t) + 1)
            needles.append((g, 10 * i + k, t[a : a + random.choice([1, 2, 3, 7, 20, 130, 400])] if k else text(12)))
    needles += [(0, 9000, ""), (0, 9001, None), (7, 9002, "ab"), (1, 9003, "a" * 200)]
    schema = "_by long, _id long, _text string"
    got = {tuple(r) for r in contained(spark.createDataFrame(needles, schema), spark.createDataFrame(hays, schema)).collect()}
    want = {(g, n, h) for g, n, s in needles if s for g2, h, t in hays if g == g2 and s in t}
    assert got == want and len(want) > 200
    assert contained(spark.createDataFrame([], schema), spark.createDataFrame(hays, schema)).isEmpty()


@pytest.mark.parametrize("tier", TIERS)
def test_grams_of_a_part_are_grams_of_the_whole(tier):
    rng = np.random.default_rng(tier)
    whole = rng.integers(97, 100, 2000).astype(np.uint8)
    for a in (0, 13, 700):
        assert set(minimisers(whole[a : a + 3 * tier], tier)) <= set(minimisers(whole, tier))
    assert len(minimisers(whole[: tier - 1], tier)) == 0 and len(minimisers(whole[:tier], tier)) == 1


LONG = "a long line of a tool's result that says the same thing over and over, " * 3


def surface(spark):
    wanted = [
        (1, 0, "user", "m0", "shown as it is"),
        (1, 1, "toolResult", "m1", LONG[5:150]),
        (1, 2, "assistant", "m2", LONG[5:150]),
        (1, 3, "user", "m3", "part"),
        (1, 4, "assistant", "m4", "of its own message"),
        (1, 5, "assistant", "m5", "quoted before"),
        (1, 6, "assistant", "m6", "new"),
        (1, 7, "user", "m7", "new"),
        (1, 8, "user", "m8", "newer"),
        (2, 0, "user", "m0", "shown as it is"),
        (3, 0, "user", "m0", ""),
    ]
    shown = [(1, "x", "shown as it is", False), (1, "y", LONG, False), (1, "z", "a part of", False), (1, "m4", "> of its own message <", False), (1, "seg-1", "## earlier assistant turn, quoted verbatim · m5\nquoted before", True), (3, "q", "", False)]
    w = spark.createDataFrame(wanted, "session long, idx long, kind string, parent string, text string")
    return w, spark.createDataFrame(shown, "session long, id string, text string, injected boolean")


def test_visible(spark):
    wanted, shown = surface(spark)
    assert {tuple(r) for r in assembly.visible(wanted, shown).collect()} == {(1, 0), (1, 1), (1, 4), (1, 5)}


def steps(spark, **change):
    base = {"enabled": True, "step": 2, "every_step": False, "messages": [("hi", False), ("there", False)]} | change
    return spark.createDataFrame([(s, *base.values()) for s in (1, 2, 3)], "session long, enabled boolean, step int, every_step boolean, messages array<struct<text string, claimed boolean>>")


def test_delivery_reasons_in_order(spark):
    wanted, shown = surface(spark)
    run = lambda most=0, **x: {r.session: r for r in assembly.delivery(steps(spark, **x), wanted, shown, most).collect()}
    got = run()
    one = got[1]
    assert (one.reason, one.candidates, one.visible, one.duplicates, one.deferred, one.delivered, one.at) == (None, 9, 4, 1, 0, 4, 2)
    assert got[2].reason is None and got[2].delivered == 1 and got[3].delivered == 1  # an empty text is wanted, and nowhere shown
    assert run(messages=[("hi", True), ("there", False)])[1].at == 1
    assert run(enabled=False)[1].reason == "off" and run(step=1, messages=[])[1].reason == "no step" and run(messages=[])[1].reason == "no messages"
    assert run(messages=[], every_step=True)[1].reason is None and run(messages=[], every_step=True)[1].at == 0
    assert run(most=1)[1].reason == "deferred"
    text = "## earlier user turn, quoted verbatim · m0\nshown as it is"
    assert run(messages=[(text, False)])[2].reason == "already there" and run(messages=[(text, False)])[2].payload is None
    none = assembly.delivery(steps(spark), wanted.where("session = 1 AND idx < 2"), shown).collect()
    assert {r.reason for r in none} == {"nothing to insert"}


def test_a_copy_of_a_deferred_text_is_asked_again(spark):
    rows = [(1, 0, "assistant", "a-very-long-name-of-a-message-that-costs-much", "x"), (1, 1, "user", "m", "x"), (1, 2, "user", "n", "x")]
    wanted = spark.createDataFrame(rows, "session long, idx long, kind string, parent string, text string")
    shown = spark.createDataFrame([], "session long, id string, text string, injected boolean")
    got = {r.session: r for r in assembly.delivery(steps(spark), wanted, shown, 12).collect()}[1]
    assert (got.deferred, got.delivered, got.duplicates) == (1, 1, 1)


def test_parents_of_a_payload(spark):
    wanted, _ = surface(spark)
    joined = F.array_join(F.collect_list(assembly.rendered(F.col("kind"), F.col("parent"), F.col("text"))), "\n\n")
    got = wanted.where("session = 1").coalesce(1).sortWithinPartitions("idx").agg(assembly.provenance_ids(joined)).first()[0]
    assert got == [f"m{i}" for i in range(9)]


def test_siblings_of_any_length(spark):
    texts = ["", "abc", "b", "", "xabcx", "abc", "z"]
    rows = spark.createDataFrame([(1, "p", i, i, t) for i, t in enumerate(texts)], "session long, parent string, idx long, pos long, text string")
    got = {r.idx: r.kept for r in assembly.not_contained(rows).collect()}
    assert got == {i: not any(t in u for u in texts[:i]) for i, t in enumerate(texts)}
