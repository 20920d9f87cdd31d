"""The divergence of sources against brute force over dense vocabularies."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import documents, edges, empty
from weftline.llm import source_audit as audit
from weftline.llm.source_audit import source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", (text or "").translate(LOWER)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups.add((lang, source))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        own, whole = p(counts[lang, source]), p(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pair = [(s, sum(f(own[t], other[t]) for t in kept)) for la, s in groups if la == lang and s != source for other in [p(counts[la, s])]]
        term = [(t, f(own[t], whole[t])) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pair, None), ("term", term, 10)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def made(spark):
    random.seed(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["é", "ÉCOLE", "Ab_cd", "語 語"]
    rows = [(i, " ".join(random.choices(words[: random.choice([5, 50, 304])], k=random.choice([0, 3, 40]))), random.choice(["en", "de"]), f"s{min(int(random.expovariate(0.3)), 14)}") for i in range(600)]
    return spark.createDataFrame(rows + [(900, None, None, None), (901, "lonely", "xx", "a"), (902, "", "xx", "b")], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize(("make", "least"), [(documents, 10), (edges, 1), (edges, 10), (made, 10), (empty, 10)])
def test_source_audit(spark, make, least):
    df = make(spark)
    got = source_audit(df, least=least).collect()
    assert {tuple(r) for r in got} == brute([(r.lang, r.source, r.text) for r in df.collect()], least) and len(got) == len(set(got))


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    df = made(spark)
    want = brute([(r.lang, r.source, r.text) for r in df.collect()], 10)
    for name, value in (("BLOCK", 97), ("CELLS", 60), ("STEP", 50), ("ENTRIES", 40)):
        monkeypatch.setattr(audit, name, value)
    assert {tuple(r) for r in source_audit(df).collect()} == want


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, 9, 3), (10**15, 10**15, 1), (10**12 + 7, 8 * 10**15, 10**9), (5, 7, 1)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(audit.share(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]
