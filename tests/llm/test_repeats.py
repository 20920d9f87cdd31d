"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import documents, edges, empty, texts
from weftline.llm.substring_dedup import factors, substring_dedup
from weftline.llm.suffix_dedup import group_starts, repeated_starts, suffix_dedup

NONE = -(2**63)


def words_brute(rows, n=13):
    words = [(NONE if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for p in range(j, j + n)}
        out.append((None if i == NONE else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return Counter(out)


def bytes_brute(rows, n=200):
    data = [(i, t.encode()) for i, t in rows]
    times = Counter(b[j : j + n] for _, b in data for j in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - n + 1):
            if times[b[j : j + n]] > 1:
                gone[j] += 1
                gone[j + n] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append((i, len(b), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("make", [documents, edges, empty])
def test_substring_dedup(spark, make):
    df = make(spark)
    got = substring_dedup(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == words_brute(texts(df))
    assert all(sum(s.words for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("make", [documents, edges, empty])
def test_suffix_dedup(spark, make):
    df = make(spark)
    got = suffix_dedup(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == bytes_brute(texts(df))


def test_factors_check_their_boundaries():
    run = lambda *w: np.array(w, np.uint32).tobytes()
    index = {}
    for text in (run(1, 2, 3, 4), run(3, 4, 5, 6)):
        for j in range(2):
            index.setdefault(text[j * 4 : j * 4 + 12], (text, j))
    assert factors(run(9, 1, 2, 3, 4, 5, 6, 9), index, 3) == [(1, 4), (3, 4)]


def test_merged_transforms_find_every_repeat(monkeypatch):
    random.seed(3)
    parts = [bytes(random.choices(b"ab", k=60)) for _ in range(12)]
    strings = list({b"".join(random.choices(parts, k=random.randrange(1, 9))) for _ in range(60)})
    weights = [random.choice([1, 1, 1, 2]) for _ in strings]
    for k in (50, 100):
        times = Counter()
        for s, w in zip(strings, weights, strict=True):
            for j in range(len(s) - k + 1):
                times[s[j : j + k]] += w
        want = [[j for j in range(len(s) - k + 1) if times[s[j : j + k]] > 1] for s in strings]
        for shards in (1, 2, 5):
            assert [x.tolist() for x in repeated_starts(strings, weights, k, shards=shards)] == want
        monkeypatch.setattr("weftline.llm.suffix_dedup.MERGE", 2000)
        assert [sorted(set(x.tolist())) for x in group_starts(strings, weights, k)] == want
        monkeypatch.undo()


def test_suffix_dedup_needs_a_fit_length(spark):
    with pytest.raises(ValueError, match="power of two"):
        suffix_dedup(edges(spark), length=130)


def thue_morse(n):
    """A word over a and b, and its complement: equal under any polynomial modulo 2^64 with an odd base from 1,024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_range_hashes_tell_long_patterns_apart():
    from weftline.llm.common import range_hashes

    for n in (2, 512, 1024, 4096, 65536):
        a, b = thue_morse(n)
        data = np.frombuffer((a + b + a).encode(), np.uint8)
        h = range_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] != h[1] and h[0] == h[2]


def test_range_hashes_tell_short_ranges_apart():
    from weftline.llm.common import range_hashes

    for kind in (np.uint8, np.uint64):
        data = np.arange(256).astype(kind)
        one = range_hashes(data, np.arange(256), np.arange(1, 257))
        two = range_hashes(np.repeat(data, 2), np.arange(0, 512, 2), np.arange(2, 513, 2))
        every = [range_hashes(data, np.arange(256 - n), np.arange(n, 256)) for n in range(3, 9)]
        assert len(np.unique(np.concatenate([one, two, *every]))) == 512 + sum(map(len, every))


@pytest.mark.parametrize("pair", [("w199452", "w287357"), ("w122419", "w294087"), thue_morse(1024), thue_morse(4096)])
def test_words_that_hashes_may_take_for_one(spark, pair):
    rest = [f"x{i}" for i in range(12)]
    rows = [(10 * j + k, " ".join([*rest[:j], word, *rest[j:]])) for j in range(13) for k, word in enumerate(pair)]
    rows += [(500, " ".join(["y", *rest[:5], pair[1], *rest[5:], "z"])), (501, "  ".join([*rest[:5], pair[0], *rest[5:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(df).collect())
    assert got == words_brute(rows) and sum(r[2] > 0 for r in got) == 2


@pytest.mark.parametrize("n", [1024, 4096])
def test_encoding_of_patterns(spark, n):
    from weftline.llm.sentencepiece_codec import round_trip

    a, b = thue_morse(n)
    df = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {b}")], "doc_id long, text string")
    apart = spark.createDataFrame([(1, b)], "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in round_trip(df).collect()}
    assert got[1] == round_trip(apart).first().asDict() and {**got[0], "doc_id": 1} != got[1]


def test_overlap_with_patterns(spark):
    from weftline.llm.decontaminate import overlaps

    a, b = thue_morse(1024)
    item = " ".join([a, *(f"{a[:40]}{i}" for i in range(3))])
    docs = spark.createDataFrame([(0, item), (1, item.replace(a, b, 1).replace(a[:40], b[:40]))], "doc_id long, text string")
    found = overlaps(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {0}
