"""Exact dedup against brute force, also where all hashes clash."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, edges, empty, texts
from weftline.llm.exact_dedup import exact_dedup, without_copies

NONE = -(2**63)


def brute(rows):
    said = [(NONE if i is None else i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in rows]
    groups = defaultdict(list)
    for i, t in said:
        groups[t].append(i)
    back = lambda i: None if i == NONE else i
    return Counter((back(i), back(min(groups[t])), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in said)


@pytest.mark.parametrize("make", [documents, edges, empty])
@pytest.mark.parametrize("digest", [F.md5, lambda c: F.md5(F.substring(c, 1, 1))])
def test_exact_dedup(spark, make, digest):
    df = make(spark)
    assert Counter(map(tuple, exact_dedup(df, digest=digest).collect())) == brute(texts(df))


def test_white_space_and_a_large_group(spark):
    rows = [(i, "one\t\ntwo " if i % 3 else "one two ") for i in range(3000)] + [(9000, "one two"), (9001, "one two "), (9002, " one two ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert Counter(r.group_size for r in got.values()) == {3000: 3000, 1: 3} and [i for i, r in got.items() if r.kept and i < 9000] == [0]


def test_kept_rows_are_whole(spark):
    df = edges(spark)
    kept = without_copies(df)
    assert kept.columns == df.columns
    want = {(i, s) for i, _, _, k, s in brute(texts(df)) if k}
    assert Counter((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()).keys() == want
