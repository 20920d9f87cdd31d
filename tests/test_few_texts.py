"""Groups of few texts are compared where they meet; the result is the same as by grams."""

import random

import pytest

from weftline.operators import containment
from weftline.operators.containment import contained


def sides(spark):
    random.seed(9)
    text = lambda: "".join(random.choice("ab ") for _ in range(random.randrange(0, 9)))
    rows = [(by, i, text()) for by in range(6) for i in range(5 + 9 * by)] + [(None, 0, "a"), (None, 1, "ab"), (7, 0, None), (7, 1, ""), (7, 2, "x")]
    hays = [(by, f"h{i}", t + text()) for by, i, t in rows if t is not None]
    return spark.createDataFrame(rows, "_by long, _id long, _text string"), spark.createDataFrame(hays, "_by long, _id string, _text string")


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("few", [0, 32, 1000])
def test_pairs_are_the_same_for_any_bound(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW_TEXTS", few)
    needles, hays = sides(spark)
    some, others = ([r for r in df.collect() if r._by is not None and r._text is not None] for df in (needles, hays))
    assert pairs(contained(needles, hays)) == sorted((n._by, n._id, h._id) for n in some for h in others if n._by == h._by and n._text and n._text in h._text)
    assert pairs(contained(needles, needles, same=True)) == sorted((n._by, n._id, h._id) for n in some for h in some if n._by == h._by and n._text and n._text in h._text and n._id != h._id)


def test_few_texts_have_no_grams(spark, monkeypatch):
    def by_grams(*_):
        raise AssertionError("grams of a small group")

    monkeypatch.setattr(containment, "_by_grams", by_grams, raising=False)
    rows = spark.createDataFrame([(1, 0, "abc"), (1, 1, "b"), (2, 0, "b")], "_by long, _id long, _text string")
    got = contained(rows, rows, same=True)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString() and pairs(got) == [(1, 1, 0)]


def test_large_texts_count_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(containment, "FEW_BYTES", 20)
    rows = spark.createDataFrame([(1, 0, "abcdefghijklmnop"), (1, 1, "bcdefgh"), (2, 0, "ab"), (2, 1, "b")], "_by long, _id long, _text string")
    got = contained(rows, rows, same=True)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and pairs(got) == [(1, 1, 0), (2, 1, 0)]
