"""Lines that other documents hold, against comparing all pairs, and how many lines are looked for in texts."""

import random

import numpy as np

from weftline.functions.grams import minimisers, minimisers_of
from weftline.operators import assembly
from weftline.operators.containment import held_lines


def words(n):
    return " ".join("".join(random.choice("abcdéz") for _ in range(5)) for _ in range(n))


def test_held_lines_equal_all_pairs(spark):
    random.seed(6)
    base = [words(30) for _ in range(12)]
    rows = []
    for doc in range(40):
        for _ in range(3):
            line = random.choice(base)
            rows.append((doc % 2, doc, random.choice([line, line + words(1), words(4) + line + words(4), line[: random.randrange(128, len(line))], line.replace("a", "b", 1), words(26)])))
    rows += [(0, None, base[0]), (0, 100, base[1] + "é"), (0, 100, base[1]), (1, 101, "x" * 128), (1, 102, "x" * 200), (1, 103, "x" * 127 + "y")]
    rows = sorted(set(rows), key=str)
    got = {r._doc: (r.lines, r.held) for r in held_lines(spark.createDataFrame(rows, "_by long, _doc long, _line string")).collect()}
    want = {}
    for by, doc, line in rows:
        held = doc is not None and any(b == by and o is not None and o != doc and line in text for b, o, text in rows)
        n, h = want.get(doc, (0, 0))
        want[doc] = n + 1, h + held
    assert got == want and 20 < sum(h for _, h in want.values()) < sum(n for n, _ in want.values()) - 10


def test_few_grams_are_shared_after_an_edit():
    random.seed(7)
    unseen = 0
    for _ in range(100):
        a = bytearray(words(60).encode())
        b = bytearray(a)
        b[random.randrange(100, len(b) - 100)] ^= 1
        both = np.frombuffer(bytes(a + b), np.uint8)
        at, grams = minimisers_of(both, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]), 128, 2)
        unseen += set(grams[at == 1]) <= set(grams[at == 0])
    assert unseen < 25


def test_grams_of_texts_side_by_side_are_grams_of_each():
    random.seed(8)
    texts = [np.frombuffer(words(n).encode(), np.uint8) for n in (1, 30, 0, 50, 22)]
    ends = np.cumsum([len(t) for t in texts])
    for tier in (1, 8, 128):
        at, grams = minimisers_of(np.concatenate(texts), ends - [len(t) for t in texts], ends, tier)
        assert [list(grams[at == i]) for i in range(5)] == [list(np.sort(minimisers(t, tier).view(np.uint64)).view(np.int64)) for t in texts]


def test_siblings_meet_only_at_what_others_have(spark):
    rows = spark.createDataFrame([(1, "p", 0, 0, "abc"), (1, "p", 1, 1, "bc"), (2, "p", 0, 0, "bc"), (1, "q", 2, 2, "c"), (1, "p", 3, 3, "xyz")], "session long, parent string, idx long, pos long, text string")
    got = {(r.session, r.idx): r.kept for r in assembly.not_contained(rows).collect()}
    assert got == {(1, 0): True, (1, 1): False, (2, 0): True, (1, 2): True, (1, 3): True}
