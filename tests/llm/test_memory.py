"""What a worker holds between tasks, and how many workers a task has."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.cases import documents, edges, empty
from weftline.llm import common
from weftline.llm.sentencepiece_codec import encode, round_trip, with_decoded


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_a_task_encodes_and_decodes_in_one_worker(spark):
    assert python_steps(corpus_pipeline.pieces(spark, edges(spark), "")) == 1
    assert python_steps(round_trip(edges(spark))) == 1


def test_decoding_beside_encoding_is_with_decoded(spark):
    for df in (documents(spark), edges(spark), empty(spark)):
        one, two = encode(df, decoded_col="decoded"), with_decoded(encode(df))
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    with pytest.raises(ValueError, match="decoded_col"):
        encode(edges(spark).withColumnRenamed("kept", "decoded"), decoded_col="decoded")


def test_freed_memory_goes_back():
    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    blocks = [bytes(2000) for _ in range(100_000)]  # the last one stays, so that the heap's end does
    blocks = blocks[-1:]
    before = held()
    common.release_memory()
    assert before - held() > 100
    del blocks
