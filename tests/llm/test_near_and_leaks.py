"""Near-dedup and decontamination against brute force and planted cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import documents, edges, empty, texts
from weftline.llm import decontaminate, near_dedup
from weftline.llm.decontaminate import overlaps, without_overlaps
from weftline.llm.near_dedup import keep_one, near_duplicates, signatures, similarity


def words_of(text):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", text.lower())


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in set(a) & set(b))


def brute(rows, similar=0.8):
    """The least position of each row's class, by comparing every pair that shares a shingle."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((sum(bags[i].values()), sum(bags[j].values())))
            alike = rows[i][1] == rows[j][1] or (small and small >= 0.5 * large and not bags[i].keys().isdisjoint(bags[j]) and probability_jaccard(bags[i], bags[j]) >= similar - 1e-9)
            if alike and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def family(n, seed=1):
    """Near copies of one text, chained so that ends are unlike, among others that are alone."""
    random.seed(seed)
    now, out = [f"w{random.randrange(5000)}" for _ in range(300)], []
    for i in range(n):
        now = now.copy()
        for _ in range(3):
            now[random.randrange(len(now))] = f"x{i}{random.randrange(99)}"
        out.append((i, " ".join(now)))
        out.append((1000 + i, " ".join(f"y{random.randrange(10**6)}" for _ in range(60))))
    return out


def partition_of(ids, classes):
    groups = {}
    for i, c in zip(ids, classes, strict=True):
        groups.setdefault(c, []).append(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("rows", [None, family(40)], ids=["documents", "family"])
def test_classes_equal_brute_force(spark, rows):
    df = documents(spark) if rows is None else spark.createDataFrame(rows, "doc_id long, text string")
    rows = texts(df)
    got = near_duplicates(df).collect()
    want = brute(rows)
    assert partition_of([r.doc_id for r in got], [r.class_id for r in got]) == partition_of([i for i, _ in rows], want)
    assert all(r.class_id == min(x.doc_id for x in got if x.class_id == r.class_id) for r in got)
    kept = sorted(r.doc_id for r in keep_one(df).collect())
    assert kept == sorted({r.class_id for r in got})


def test_members_that_lack_other_stretches_are_not_paired(spark):
    by = {k: [20 if i == at else 0 for i in range(32)] for k, at in ((1, 0), (2, 5), (3, 0))}
    rows = [(7, k, k, 100, 95, 20, by[k], [10 * k]) for k in by]
    group = spark.createDataFrame(rows, "_g long, _k long, _c long, _w long, _wl long, _lacks long, _by array<int>, _own array<long>")
    buckets = {}
    for r in near_dedup.parted(group, 0.8).collect():
        buckets.setdefault(r["_key"], set()).add(r["_k"])
    assert [x for x in buckets.values() if len(x) > 1] == [{1, 3}]


def test_near_edges(spark):
    got = near_duplicates(edges(spark)).collect()
    assert len(got) == 12
    # the two rows of id 1 with one text, the null id's longer text and the upper-case one are near; empty texts are one class
    near = Counter((r.class_id, r.class_size) for r in got)
    assert max(near.values()) == 4 and any(r.doc_id == 4 and r.class_id == 4 for r in got)
    assert sum(1 for r in got if r.doc_id in (2, 3)) == 2 and len({r.class_id for r in got if r.doc_id in (2, 3)}) == 1
    out = keep_one(edges(spark))
    assert out.columns == edges(spark).columns and out.count() == len({(r.class_id, r.class_size) for r in got if r.class_id is not None}) + 2
    assert near_duplicates(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


def test_similarity_and_signatures():
    random.seed(2)
    for _ in range(30):
        a, b = (Counter(random.choices(range(40), k=60)) for _ in range(2))
        sides = [tuple(np.array(x) for x in zip(*sorted(c.items()), strict=True)) for c in (a, b)]
        assert similarity(*[(k.astype(np.uint64), v) for k, v in sides]) == pytest.approx(probability_jaccard(a, b))
    from weftline.llm.common import mixed

    keys = [mixed(k.astype(np.uint64) + np.uint64(99)) for k, _ in sides]
    rows = np.concatenate([np.full(len(k), i) for i, k in enumerate(keys)])
    got = signatures(rows, np.concatenate(keys), np.concatenate([v for _, v in sides]).astype(float), 2, 4000)
    assert (got[0] == got[1]).mean() == pytest.approx(probability_jaccard(a, b), abs=0.04)


def overlaps_brute(docs, items):
    """(document, item) pairs: some alignment has a run of 13 words (the item's length, if less) of which three quarters agree."""
    found, told = set(), {i: words_of(t or "") for i, t in items.items()}
    for d, text in docs.items():
        own = np.array(words_of(text))
        for i, item in told.items():
            width = min(13, len(item))
            if not width or len(own) < width or len(set(own) & set(item)) * 4 < 3 * width and len(set(item)) == len(item):
                continue
            for zero in range(width - len(item), len(own) - width + 1):
                a, b = max(zero, 0), min(zero + len(item), len(own))
                total = np.concatenate(([0], np.cumsum(own[a:b] == np.array(item[a - zero : b - zero]))))
                if (4 * (total[width:] - total[:-width]) >= 3 * width).any():
                    found.add((d, i))
                    break
    return found


def planted(spark):
    random.seed(4)
    fresh = lambda n: [f"q{random.randrange(10**6)}" for _ in range(n)]
    items = [fresh(n) for n in (40, 16, 25)]
    noise = lambda: fresh(50)
    swapped = [w if i % 8 else "other" for i, w in enumerate(items[0])]
    docs = [noise() + items[0] + noise(), noise() + swapped + noise(), items[1], noise() + items[2][5:20], noise(), noise() + items[2][:6] + noise(), [w.upper() + "," for w in items[0]]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), bench


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_leaks_are_found_and_clean_documents_are_not(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, bench = planted(spark)
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.n_same) for r in overlaps(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (6, 0)}
    assert got[0, 0] == (50, 40, 40) and got[2, 1] == (0, 16, 16)
    assert sorted(r.doc_id for r in without_overlaps(docs, bench).collect()) == [4, 5]


def test_leaks_on_the_documents(spark):
    df, bench = documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: words_of(r.text) for r in bench.collect()}
    grams = {}
    for i, w in items.items():
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(i)
    got = {(r.doc_id, r.item_id) for r in overlaps(df, bench).collect()}
    assert got == overlaps_brute(dict(texts(df)), {r.item_id: r.text for r in bench.collect()})
    exact = {(d, i) for d, t in texts(df) for w in [words_of(t)] for j in range(len(w) - 12) for i in grams.get(tuple(w[j : j + 13]), ())}
    assert exact <= got


def test_leak_edges(spark):
    bench = spark.createDataFrame([(None, "The quick brown fox jumps over the lazy dog while seven wise owls watch"), (1, None), (2, "short")], "item_id long, text string")
    got = overlaps(edges(spark), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, None), (1, None), (None, None), (7, None)])
    assert overlaps(empty(spark), bench).count() == 0 and overlaps(edges(spark), bench.where("false")).count() == 0
    left = without_overlaps(edges(spark), bench)
    assert left.columns == edges(spark).columns and left.count() == 8


def test_masks_fit_every_pattern_that_passes():
    from itertools import combinations
    from math import ceil

    for width in range(1, 14):
        spare = width - ceil(0.75 * width)
        for gone in combinations(range(width), spare):
            assert any(all(m == "0" or j + o not in gone for j, m in enumerate(mask)) for mask in decontaminate.masks_of(width) for o in range(width - len(mask) + 1)), (width, gone)
    assert len(list(combinations(range(13), 3))) == 286 and max(map(len, decontaminate.MASKS)) <= 13


def test_leaks_with_every_fourth_or_fifth_word_replaced_and_in_short_items(spark):
    random.seed(6)
    fresh = lambda n: [f"q{random.randrange(10**6)}" for _ in range(n)]
    items = {n: fresh(n) for n in (1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 13, 15, 20, 40)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    docs, want = [], set()
    for n, w in items.items():
        for step in (0, 4, 5):
            for phase in range(step or 1):
                told = [x if not step or (j + phase) % step else "other" for j, x in enumerate(w)]
                width, same = min(13, n), [a == b for a, b in zip(told, w, strict=True)]
                passes = any(4 * sum(same[j : j + width]) >= 3 * width for j in range(n - width + 1))
                docs.append((len(docs), " ".join(fresh(20) + told + fresh(20))))
                want |= {(docs[-1][0], n)} if passes else set()
    got = {(r.doc_id, r.item_id) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want and {n for _, n in want} == set(items)
