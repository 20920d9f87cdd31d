"""Candidate search for repeated windows, shared by the two substring operators.

Each window of k units (words or bytes) belongs to the run of windows that have the same least m-gram, the run's anchor.
Equal windows have equal anchors, so a window whose anchor occurs once in the corpus is not repeated, and all occurrences
of a window meet at one anchor. Only anchors are counted over the whole corpus; only the runs at repeated anchors are moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, column, mixed, range_hashes, shuffle_partitions

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def anchor_rows(docs: DataFrame, runs_of) -> DataFrame:
    """(_id, _anchor, _n): how often each document has each anchor. runs_of(batch) -> bounds, (doc, first, last, anchor)."""

    def rows(batches):
        for batch in chunks(batches):
            _, (doc, _, _, anchor) = runs_of(batch)
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column(batch, "_id")[doc[at]]), pa.array(anchor[at].view(np.int64)), pa.array(np.diff(np.append(at, len(doc))).astype(np.int32))], ["_id", "_anchor", "_n"]
            )

    return docs.select("_id", "_text").mapInArrow(rows, "_id long, _anchor long, _n int")


def candidate_runs(docs: DataFrame, wanted: DataFrame, runs_of, units_of) -> DataFrame:
    """(_anchor, _id, _k, _starts, _run): the runs of each document at the anchors that ``wanted`` (_id, _anchors) lists for it.

    Equal runs of a document at one anchor, as periodic texts have them, are one row with all their starts. units_of(units, first, last)
    -> data, bounds, begins, ends: what is moved, each document's first unit, and where in the data each run begins and ends.
    """

    def rows(batches):
        for batch in chunks(batches):
            units, (doc, first, last, anchor) = runs_of(batch)
            lists = batch.column(batch.schema.get_field_index("_anchors"))
            at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            flat = flat[at[0] : at[-1]]
            owner = np.repeat(np.arange(len(lists)), np.diff(at)).astype(np.uint64)
            # both sides as one key; a clash only adds a candidate
            own = anchor ^ (doc.astype(np.uint64) * _SPREAD)
            keep = np.flatnonzero(np.isin(own, flat ^ (owner * _SPREAD)))
            doc, first, last, anchor, own = doc[keep], first[keep], last[keep], anchor[keep], own[keep]
            data, bounds, begins, ends = units_of(units, first, last)
            _, some, which = np.unique(mixed(range_hashes(data, begins, ends) ^ own), return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(some))))).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array((first - bounds[doc])[order].astype(np.int32)))
            arrays = [pa.array(anchor[some].view(np.int64)), pa.array(column(batch, "_id")[doc[some]]), pa.array(column(batch, "_k")[doc[some]]), starts, packed(data, begins[some], ends[some])]
            yield pa.RecordBatch.from_arrays(arrays, ["_anchor", "_id", "_k", "_starts", "_run"])

    joined = docs.join(wanted, "_id")
    return joined.select("_id", "_k", "_text", "_anchors").mapInArrow(rows, "_anchor long, _id long, _k long, _starts array<int>, _run binary")


def run_rows(batch: pa.RecordBatch):
    """(anchor, id, k, starts, run) of each row."""
    lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_anchor", "_id", "_k", "_starts", "_run")]
    return zip(*lists, strict=True)


def span_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["_id", "_k", "_start", "_len"])


def at_one_place(runs: DataFrame) -> DataFrame:
    """Brings the runs of an anchor together, in order of document."""
    return runs.repartition(shuffle_partitions(runs.sparkSession), "_anchor").sortWithinPartitions("_anchor", "_id")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document with ``_spans``, the (_k, _start, _len) found for its id; the text's shuffle is the one of candidate_runs."""
    return docs.join(spans.groupBy("_id").agg(F.collect_list(F.struct("_k", "_start", "_len")).alias("_spans")), "_id", "left")


def own_spans(batch: pa.RecordBatch):
    """For each row of a batch from with_spans: starts and lengths of its own spans."""
    keys = column(batch, "_k")
    for k, spans in zip(keys, batch.column(batch.schema.get_field_index("_spans")), strict=True):
        if not spans.is_valid:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        v = spans.values
        mine = v.field("_k").to_numpy(zero_copy_only=False) == k
        yield v.field("_start").to_numpy(zero_copy_only=False)[mine].astype(np.int64), v.field("_len").to_numpy(zero_copy_only=False)[mine].astype(np.int64)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A mask of the n units that the spans cover."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of data[start:end] for each start and end."""
    sizes = (ends - starts).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    body = np.ascontiguousarray(data[take]).view(np.uint8)
    wide = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * wide).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
