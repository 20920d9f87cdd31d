"""The paired analysis: statuses, refusals, and numbers against plain Python."""

import math
import random

import pytest

from weftline.operators import paired
from weftline.operators.analysis import Metric, Plan, analyze

ARMS = ("base", "t1", "t2")
PLAN = {"arms": ARMS, "baseline": "base", "primary": "solved", "family": {"cost": Metric(0.1, False)}, "min_n": 5, "resamples": 300}
SCHEMA = "by string, key long, arm string, metric string, value double"


def rows_of(n=8, by="x"):
    random.seed(n)
    return [(by, k, a, m, float(random.random() < 0.5) if m == "solved" else random.choice([10.0, 12.0, 20.0]) * (0.5 if a == "t2" else 1)) for k in range(n) for a in ARMS for m in ("solved", "cost")]


def test_statuses_and_refusals(spark):
    whole = rows_of(8, "ok")
    unpaired = [r for r in rows_of(8, "unpaired") if (r[1], r[2]) != (3, "t1")]
    holes = [(*r[:4], None) if r[1:4] == (2, "t2", "cost") else r for r in rows_of(8, "holes")]
    few = rows_of(4, "few")
    df = spark.createDataFrame([*whole, *unpaired, *holes, *few, *few[:5]], SCHEMA)
    got = analyze(df, Plan(**PLAN))
    status = {r.by: r for r in got.experiments.collect()}
    assert {k: v.status for k, v in status.items()} == {"ok": "ok", "unpaired": "insufficient-pairing", "holes": "insufficient-pairing", "few": "insufficient-n"}
    assert (status["unpaired"].keys, status["unpaired"].shared, status["unpaired"].pairs, status["unpaired"].success) == (8, 7, None, None) and status["ok"].pairs == 8
    refused = {(r.by, r.kind, r.metric, r.key, tuple(r.missing), r["count"]) for r in got.refusals.collect()}
    assert refused == {
        ("unpaired", "insufficient-pairing", None, 3, ("t1",), None),
        ("holes", "insufficient-pairing", "cost", 2, ("t2",), None),
        ("few", "insufficient-n", "solved", None, (), 4),
        ("few", "insufficient-n", "cost", None, (), 4),
    }
    assert {r.by for r in got.primary.collect()} == {r.by for r in got.secondary.collect()} == {"ok"}
    loose = analyze(df, Plan(**PLAN, allow_drop=True))
    assert {r.by: (r.status, r.pairs) for r in loose.experiments.collect()} == {"ok": ("ok", 8), "unpaired": ("ok", 7), "holes": ("ok", 8), "few": ("insufficient-n", None)}
    assert {r.by: r.n for r in loose.secondary.where("treatment = 't2'").collect()} == {"ok": 8, "unpaired": 7, "holes": 7}


def test_numbers(spark):
    rows = rows_of(9)
    got = analyze(spark.createDataFrame(rows, SCHEMA), Plan(**PLAN))
    value = {r[1:4]: r[4] for r in rows}
    low32 = 0xFFFFFFFF

    def draw(k):
        a = (20261002 + k * 0x6D2B79F5) & low32
        t = ((a ^ a >> 15) * (a | 1)) & low32
        t ^= (t + ((t ^ t >> 7) * (t | 61) & low32)) & low32
        return ((t ^ t >> 14) & low32) / 4294967296

    tests = {}
    for r in got.secondary.collect():
        d = [value[k, r.treatment, "cost"] - value[k, "base", "cost"] for k in range(9)]
        means = sorted(sum(d[int(draw(s * 9 + i) * 9)] for i in range(1, 10)) / 9 for s in range(300))
        at = lambda q: means[int(q * 299)] + (q * 299 - int(q * 299)) * (means[math.ceil(q * 299)] - means[int(q * 299)])  # noqa: B023, E731
        below, above = sum(m <= 0 for m in means) / 300, sum(m >= 0 for m in means) / 300
        base = sum(value[k, "base", "cost"] for k in range(9)) / 9
        assert (r.low, r.high, r.p_one, r.p) == pytest.approx((at(0.025), at(0.975), below, min(1, 2 * min(below, above))))
        assert r.line == pytest.approx(-0.1 * base) and r.improves == (r.high < r.line)
        tests[r.treatment] = r
    order = sorted(tests.values(), key=lambda r: (r.p, r.treatment))
    assert order[0].adjusted == pytest.approx(min(1, 2 * order[0].p)) and order[1].adjusted == pytest.approx(max(order[0].adjusted, order[1].p))
    for r in got.primary.collect():
        x, y = ([value[k, a, "solved"] for k in range(9)] for a in (r.treatment, "base"))
        b, c = sum(p > q for p, q in zip(x, y, strict=True)), sum(p < q for p, q in zip(x, y, strict=True))
        tail = sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)
        assert (r.b, r.c, r.test) == (b, c, "exact") and r.p == pytest.approx(min(1, tail)) and r.non_inferior == (sum(x) >= sum(y))
    one = got.experiments.first()
    assert one.success == (all(r.non_inferior for r in got.primary.collect()) and any(r.rejects and r.improves for r in tests.values()))


def test_draws_are_split_over_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(i, (i % 7) - 3) for i in range(50)], "pos long, d long")
    want = {r.resample: r.total for r in paired.bootstrap_sums(d, 40, 5).collect()}
    for name, size in (("BLOCK", 16), ("RANGE", 7), ("STEP", 13)):
        monkeypatch.setattr(paired, name, size)
    assert {r.resample: r.total for r in paired.bootstrap_sums(d, 40, 5).collect()} == want and len(want) == 40


@pytest.mark.parametrize("wrong", [{"arms": ("base",)}, {"arms": ("base", "base")}, {"baseline": "none"}, {"primary": "cost"}, {"margin": -1.0}, {"margin": 0.1}, {"alpha": 1.0}, {"min_n": 0}, {"method": "best"}])
def test_plans_that_make_no_sense(wrong):
    with pytest.raises(ValueError):
        Plan(**(PLAN | wrong))


def test_rows_of_other_arms_and_other_numbers_are_errors(spark):
    with pytest.raises(Exception, match="no such arm: t9"):
        analyze(spark.createDataFrame([*rows_of(), ("x", 1, "t9", "cost", 1.0)], SCHEMA), Plan(**PLAN))
    with pytest.raises(Exception, match="must be 0 or 1"):
        analyze(spark.createDataFrame([(*r[:4], 0.5) if r[3] == "solved" else r for r in rows_of()], SCHEMA), Plan(**PLAN)).primary.collect()
