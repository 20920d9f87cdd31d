"""Every query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from weftline.plans import analysis_queries, catalog, cell_queries, delivery_queries, demand_queries, evidence_queries, log_queries, state_queries, tree_queries  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows_of(cols, rows):
    return sorted(map(str, (tuple(plain(r[c]) for c in sorted(cols)) for r in rows)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    cols = [c[0] for c in found.description]
    want = [dict(zip(cols, r, strict=True)) for r in found.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(cols, [r.asDict() for r in df.collect()]) == rows_of(cols, want)


def test_chunks_stay_within_the_budget_and_keep_every_word(spark):
    from weftline.operators.chunker import chunked, tokens

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = chunked(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text", 128, 16).collect()
    parts = {}
    for r in rows:
        assert r.tokens == tokens(r.text) <= 128
        parts.setdefault(r.chunk_of if r.chunk_of is not None else int(r.chunk_id), []).append(r.text)
    assert parts.keys() == docs.keys() and all(set("".join("".join(parts[i]).split())) == set("".join(t.split())) for i, t in docs.items())


def test_blocks_of_lists_fences_and_headings(spark):
    from weftline.operators.chunker import blocks

    cases = {
        "# head\nintro\n\n```py\na\n\nb\n```\n- one\n\n- two\nafter": ["# head\nintro", "```py\na\n\nb\n```", "- one\n\n- two", "after"],
        "intro:\n- one\n- two\n\n- three\n  more\n\nend": ["intro:\n- one\n- two\n\n- three", "  more", "end"],
        "a\r\n# h\r\nb\n\n\n\nc": ["a", "# h\nb", "c"],
        "- x\n# h\n~~~\n```\n~~~ \nz": ["- x", "# h", "~~~\n```\n~~~ ", "z"],
        "": [],
        " \n\t\n": [],
        "```\nnever closed\n\nx": ["```\nnever closed\n\nx"],
        "```\na\n```\n```\nb\n```\n\n- i\n\n```\nc\n```": ["```\na\n```", "```\nb\n```", "- i\n", "```\nc\n```"],
        "# a\n# b\n- c\n# d": ["# a", "# b\n- c", "# d"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {}
    for r in blocks(rows).orderBy("id", "block").collect():
        got.setdefault(r.id, []).append(r.text)
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_chunks_by_hand():
    from weftline.operators.chunker import by_sentence, chunks

    # sentences of 8 characters, two tokens each: pieces of two that share one; pieces end at cuts, so what follows the last is on its own
    assert by_sentence("aaaaaa. bbbbbb. cccccc. dddddd.", 4, 2) == ["aaaaaa. bbbbbb.", "bbbbbb. cccccc.", "cccccc.", "dddddd."]
    assert by_sentence("aaaaaa. bbbbbb. cccccc. dddddd.", 4, 0) == ["aaaaaa. bbbbbb.", "cccccc.", "dddddd."]
    # without a cut: 8 characters, the last 4 again
    assert by_sentence("abcdefghijklmnop", 2, 1) == ["abcdefgh", "efghijkl", "ijklmnop"]
    # wide characters are a token each
    assert by_sentence("一二三四五", 2, 1) == ["一二", "二三", "三四", "四五"]
    # lines of a token each; the last one again; a long line is cut and stands alone, what is left of it is packed
    lines = lambda t, budget, overlap: chunks(t, [t], budget, overlap)
    assert lines("aaaa\nbbbb\ncccc", 3, 1) == ["aaaa\nbbbb", "bbbb\ncccc"]
    assert lines("aaaa\nbbbbbbbbbbbbbbbb", 3, 0) == ["aaaa", "bbbbbbbbbbbb", "bbbb"]
    # blocks within the budget are packed whole, and a trailing one within the overlap is carried on
    assert chunks("", ["aaaaaaaa", "bbbb", "cccccccc"], 4, 1) == ["aaaaaaaa\n\nbbbb", "bbbb\n\ncccccccc"]
    # what a long block finds before it stands alone if it leaves no room
    assert chunks("", ["aaaa", "bbbbbbbb. cccccccc."], 3, 1) == ["aaaa", "aaaa", "bbbbbbbb.", "cccccccc."]


def test_delivery_budget_defers_and_goes_on(spark):
    from weftline.operators.assembly import within_budget

    rows = spark.createDataFrame([(1, i, i, n) for i, n in enumerate([100, 500, 150, 60, 10])], "session long, idx long, pos long, tokens long")
    got = {r.idx: r.delivered for r in within_budget(rows, 300, 3).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_bootstrap_is_the_same_for_any_number_of_partitions(spark):
    from weftline.functions.stats import draw
    from weftline.operators.paired import bootstrap_sums, interval

    def sequential(seed, k):
        state = (seed + k * 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(1, 200).select(draw(F.col("id"), 20261002)).collect()]
    assert got == [sequential(20261002, k) for k in range(1, 200)]
    d = spark.createDataFrame([(i, (i % 3) - 1) for i in range(50)], "pos long, d long")
    one = interval(bootstrap_sums(d, 100, 7)).collect()
    many = interval(bootstrap_sums(d.repartition(7), 100, 7)).collect()
    assert one == many


@pytest.mark.parametrize(("b", "c", "p"), [(8, 1, 10 / 512), (6, 0, 1 / 64), (5, 4, 0.5), (5, 5, 638 / 1024), (0, 0, 1.0)])
def test_mcnemar_by_hand(spark, b, c, p):
    from pyspark.sql import functions as F

    from weftline.functions.stats import mcnemar_exact

    assert spark.range(1).select(mcnemar_exact(F.lit(b), F.lit(c))).first()[0] == pytest.approx(p)


@pytest.mark.parametrize(("b", "c"), [(1834, 37), (1000, 990), (700, 600), (20_000, 20_100), (37, 1834)])
def test_mcnemar_of_many_discordant_pairs(spark, b, c):
    from pyspark.sql import functions as F

    from weftline.functions.stats import mcnemar_exact

    log = lambda i: math.lgamma(b + c + 1) - math.lgamma(i + 1) - math.lgamma(b + c - i + 1) - (b + c) * math.log(2)
    want = math.fsum(math.exp(log(i)) for i in range(min(b, c) + 1))
    assert spark.range(1).select(mcnemar_exact(F.lit(b), F.lit(c))).first()[0] == pytest.approx(min(1.0, want), rel=1e-6, abs=1e-300)


def test_bootstrap_draws_ten_thousand_resamples(spark, duck):
    d = [r[0] for r in duck.execute("SELECT quality - toxic FROM labels JOIN documents USING (doc_id) ORDER BY doc_id").fetchall()]
    n, low32 = len(d), 0xFFFFFFFF

    def draw(k):
        state = (20261002 + k * 0x6D2B79F5) & low32
        t = ((state ^ state >> 15) * (state | 1)) & low32
        t ^= (t + ((t ^ t >> 7) * (t | 61) & low32)) & low32
        return ((t ^ t >> 14) & low32) / 4294967296

    means = sorted(sum(d[int(draw(s * n + i) * n)] for i in range(1, n + 1)) / n for s in range(10_000))

    def quantile(q):
        at = q * 9999
        return means[int(at)] + (at - int(at)) * (means[math.ceil(at)] - means[int(at)])

    got = QUERIES["bootstrap_ci"](spark, DATA).first()
    below, above = sum(m <= 0 for m in means) / 10_000, sum(m >= 0 for m in means) / 10_000
    assert (got.low, got.high, got.p_one, got.p_two) == pytest.approx((quantile(0.025), quantile(0.975), below, min(1.0, 2 * min(below, above))))


def test_recall_walks_like_a_plain_search(spark):
    import random

    from weftline.operators.recall import recall, walkable

    random.seed(5)
    scores, want = [], {}
    for s in range(6):
        arcs = {(a, b): random.choice([0.3, 0.6, 0.7, 0.9]) for b in range(12) for a in range(max(0, b - 5), b) if random.random() < 0.5}
        scores += [(s, a, b, w, "lexical") for (a, b), w in arcs.items()]
        level, depth = [11], {11: 0}
        for k in range(1, 4):
            new = []
            for v in level:
                for w, h in sorted(((w, h) for (h, t), w in arcs.items() if t == v and w > 0.5), key=lambda x: (-x[0], -x[1])):
                    if h not in depth:
                        depth[h] = k
                        new.append((h, v))
            level = [h for h, _ in new]
            for h, v in new:
                want[s, h] = (k, v)
    seeds = spark.createDataFrame([(s, 11) for s in range(6)], "session long, seed long")
    hits = recall(seeds, walkable(spark.createDataFrame(scores, "session long, from_idx long, to_idx long, w double, source string"), seeds, 0.5), 3)
    assert {(r.session, r.idx): (r.depth, r.via) for r in hits.collect()} == want


def test_asof_strict_and_ties(spark):
    from weftline.operators.timejoin import asof, attribute

    left = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 5, "c"), (2, 1, "d")], "k long, ts long, name string")
    right = spark.createDataFrame([(1, 10, 7), (1, 10, 9), (1, 18, 1)], "k long, ts long, v long")
    get = lambda df: {r.name: r.v for r in df.collect()}
    assert get(asof(left, right, "k", ["v"])) == {"a": 9, "b": 1, "c": None, "d": None}
    assert get(asof(left, right, "k", ["v"], strict=True)) == {"a": None, "b": 1, "c": None, "d": None}
    assert get(asof(left, right, "k", ["v"], forward=True, tolerance=4)) == {"a": 9, "b": None, "c": None, "d": None}
    frames = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 15), (1, 3, 18, None)], "k long, step long, start long, end long")
    got = {r.name: (r.step, r.scope) for r in attribute(left, frames, "k", "step").collect()}
    assert got == {"a": (1, "step"), "b": (3, "step"), "c": (1, "step"), "d": (None, "pre")}


def test_detectable_differences_and_margins(spark):
    from pyspark.sql import functions as F

    from weftline.functions.stats import detectable, margin_statistic, shifted_margin

    rows = spark.createDataFrame([(20, 5), (13, 12), (0, 0), (1, 0)], "b long, c long")
    b, c = F.col("b"), F.col("c")
    got = rows.select(detectable(b + c), margin_statistic(b, c, 0.1), shifted_margin(b, c, 0.1), shifted_margin(c, b, 0.0), shifted_margin(c, b, 0.0, True)).collect()
    assert got[0][0] == pytest.approx(2.801585218 / 5) and got[3][0] == pytest.approx(2.801585218) and got[2][0] is None
    assert got[0][1] == pytest.approx((15 / 25 + 0.1) * 5) and got[2][1] is None
    assert [r[2] for r in got[:3]] == pytest.approx([2.326e-4, 0.2420, 1], rel=1e-3)
    assert got[0][3] == pytest.approx(1 - got[0][4]) and got[0][4] == pytest.approx(1.35e-3, rel=1e-2)
    for bad in ({"alpha": 0}, {"power": 0.5}):
        with pytest.raises(ValueError):
            detectable(b, **bad)


def test_set_quality_of_empty_and_repeated_sets(spark):
    from weftline.operators.quality import set_quality

    sets = "g string, k long"
    predicted = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("c", 5)], sets)
    truth = spark.createDataFrame([("a", 2), ("a", 3), ("b", 4), ("b", 4)], sets)
    got = {r["g"]: tuple(r)[1:] for r in set_quality(predicted, truth, "k", "g").collect()}
    assert got == {"a": (1, 1, 1, 0.5, 0.5, 0.5), "b": (0, 0, 1, 0.0, 0.0, 0.0), "c": (0, 1, 0, 0.0, None, None)}
