"""The conversation trie against brute force, over any number of shards."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import DATA
from weftline.llm import prefix_trie
from weftline.llm.prefix_trie import conversation_trie, edge_deltas, shard_parts, tree_of

SCHEMA = "conv_id long, turn long, role string, text string, _k string, id string, words string, conv string, ids string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(said)] for c, said in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        said = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(said) + 1):
            members[said[:d]].append((c, d == len(said)))
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    own = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own[p]
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest() for p, m in members.items()}
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def made(seed):
    """Few different turns, so that prefixes are shared by many and end within one another."""
    random.seed(seed)
    return [(c, t, random.choice(["user", "user", "assistant"]), random.choice(["a", "b c", "b  c", ""])) for c in range(400) for t in range(random.choice([1, 2, 2, 3, 6]))]


CASES = {
    "table": None,
    "few turns": made(3),
    "edges": [
        (None, 0, "user", "lost"),
        (1, None, None, None),
        (1, 0, "user", "x"),
        (1, 0, "user", "x"),
        (1, 0, "assistant", "x"),
        (7, None, "user", "only one"),
        (20, 3, None, ""),
        (20, 1, "user", "deep " * 4000),
        (21, 1, "user", "deep " * 4000),
        (22, 1, "user", "deep " * 4000 + "er"),
        (39, 5, "tool", "\n\t"),
        (2**40, 0, "user", "x"),
    ],
    "one for all": [(c, t, "user", "same thing") for c in range(300) for t in range(4)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shard", [250_000, 40])
def test_conversation_trie(spark, case, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    df = spark.read.parquet(f"{DATA}/conversations.parquet") if CASES[case] is None else rows_of(spark, CASES[case])
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert Counter(map(tuple, conversation_trie(df).collect())) == want


def test_tree_is_balanced_and_ordered():
    seqs = [[i, i % 3] for i in range(1023)]
    tree, last = tree_of(seqs, seqs)
    depth, stack = {tree.down[0]: 1}, [tree.down[0]]
    while stack:
        t = stack.pop()
        for s in (tree.low[t], tree.high[t]):
            if s >= 0:
                depth[s] = depth[t] + 1
                stack.append(s)
    assert len(depth) == 1023 and max(depth.values()) == 10
    assert [tree.id[t] for t in tree.order() if tree.depth[t] == 1] == list(range(1023)) and len(set(last)) == 1023


def test_two_shards_count_as_one():
    seqs = [[], [1], [1, 2], [1, 2, 3], [1, 4], [2]]
    for cut in range(1, len(seqs)):
        sums = defaultdict(lambda: [0, 0, 0, 0])
        sides = [shard_parts(s, [[5] * len(x) for x in s], [2] * len(s), list(range(len(s))), ["e"] * len(s)) for s in (seqs[:cut], seqs[cut:])]
        for r in [*sides[0][:-1], *sides[1][:-1]]:
            if r[0]:
                sums[r[4]] = [a + b for a, b in zip(sums[r[4]], r[6:10], strict=True)]
        for r in edge_deltas(seqs[cut - 1], seqs[cut], [5] * len(seqs[cut])):
            sums[r[3]] = [a + b for a, b in zip(sums[r[3]], r[5:9], strict=True)]
        whole = {r[4]: list(r[6:10]) for r in shard_parts(seqs, [[5] * len(x) for x in seqs], [2] * 6, list(range(6)), ["e"] * 6)[:-1] if r[0]}
        assert all(sums[k] == v for k, v in whole.items()), cut
