"""Removal of word windows that a document with a smaller id has too, by relative Lempel-Ziv parsing."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, chunks, column, gram_hashes, id_back, keyed, range_hashes, utf8, window_runs, word_spans
from weftline.llm.repeats import anchor_rows, at_one_place, candidate_runs, covered, own_spans, run_rows, span_batch, with_spans

WORDS, GRAM = 13, 3


def _words(batch):
    data, at = utf8(batch.column(batch.schema.get_field_index("_text")))
    starts, ends, bounds = word_spans(data, at, SPACES)
    return data, starts, ends, bounds


def factors(run: bytes, index: dict[bytes, tuple[bytes, int]], window: int, wide: int = 4) -> list[tuple[int, int]]:
    """Greedy parsing of a run of words (``wide`` bytes each) against the reference runs in ``index``.

    A factor starts where the index has the next ``window`` words and goes on as long as its reference run agrees; other
    words are literals. A window that starts inside a factor and ends beyond it may have another source, so those at each
    factor's end are looked up one by one. Returns (first word, words) of every factor.
    """
    found, i, n, size = [], 0, len(run) // wide, window * wide
    while i + window <= n:
        source = index.get(run[i * wide : i * wide + size])
        if source is None:
            i += 1
            continue
        text, at = source
        length, most = window, min(n - i, len(text) // wide - at)
        while length < most and run[(i + length) * wide : (i + length + 1) * wide] == text[(at + length) * wide : (at + length + 1) * wide]:
            length += 1
        found.append((i, length))
        i += length - window + 1  # the next window is the first that the factor doesn't hold: the boundary's check goes on from it
    return found


def repeated_spans(runs: DataFrame, window: int) -> DataFrame:
    """(_id, _k, _start, _len): factors of each run against the runs of smaller ids at its anchor.

    Runs come as their words; a task numbers the words of an anchor's runs, so that equal numbers are equal words and no hash decides.
    """

    def rows(batches):
        anchor, doc, index, waiting, numbers = None, None, {}, {}, {}
        for batch in batches:
            out: list[tuple] = []
            for a, i, k, starts, run in run_rows(batch):
                if a != anchor:
                    anchor, doc, index, waiting, numbers = a, i, {}, {}, {}
                elif i != doc:
                    # the runs of a document become reference only for later ones
                    for text in waiting:
                        for j in range(len(text) // 4 - window + 1):
                            index.setdefault(text[j * 4 : (j + window) * 4], (text, j))
                    doc, waiting = i, {}
                run = array("I", [numbers.setdefault(w, len(numbers)) for w in run.split(b" ")]).tobytes()
                waiting[run] = None
                if index:
                    out.extend((i, k, start + first, length) for first, length in factors(run, index, window) for start in starts)
            yield span_batch(out)

    return at_one_place(runs).mapInArrow(rows, "_id long, _k long, _start int, _len int")


def duplicate_spans(docs: DataFrame, window: int = WORDS) -> DataFrame:
    """``keyed`` documents with ``_spans``: the word spans that hold only windows that start in a smaller id too."""

    def runs_of(batch):
        data, starts, ends, bounds = _words(batch)
        hashes = range_hashes(data, starts, ends)
        return (data, starts, ends, bounds), window_runs(gram_hashes(hashes, GRAM), bounds, window, GRAM)

    def units_of(units, first, last):
        data, starts, ends, bounds = units
        at = np.concatenate(([0], np.cumsum(ends - starts + 1)))
        # the words, each with one space after it
        joined = np.append(data, np.uint8(32))[np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts + 1)]
        joined[at[1:] - 1] = 32
        return joined, bounds, at[first], at[last + window] - 1

    anchors = W.partitionBy("_anchor")
    wanted = (
        anchor_rows(docs, runs_of).select("_id", "_anchor").withColumn("_min", F.min("_id").over(anchors)).withColumn("_max", F.max("_id").over(anchors)).where("_min < _max").groupBy("_id").agg(F.collect_list("_anchor").alias("_anchors"))
    )
    return with_spans(docs, repeated_spans(candidate_runs(docs, wanted, runs_of, units_of), window))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS) -> DataFrame:
    """Cuts out of each document the words covered by windows that also start in a document with a smaller id.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. Returns
    ``doc_id, n_words, n_removed, kept`` (the kept words joined by one space) and ``spans`` (first word and number of words of
    each removed run). Null and empty texts have no words; a null id counts as smaller than any other; rows with equal ids are
    no reference for each other; a repeated row gives a repeated result; an empty table gives no rows.
    """
    found = duplicate_spans(keyed(docs, id_col, text_col), window)

    def rows(batches):
        for batch in chunks(batches):
            data, starts, ends, bounds = _words(batch)
            raw, out = data.tobytes(), ([], [], [], [])
            for i, (at, size) in enumerate(own_spans(batch)):
                a, b = bounds[i], bounds[i + 1]
                gone = covered(b - a, at, size)
                keep = np.flatnonzero(~gone) + a
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                out[0].append(b - a)
                out[1].append(int(gone.sum()))
                out[2].append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
                out[3].append([{"start": int(x), "words": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept = pa.array(out[2], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "_id")), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), kept, pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))], ["_id", "n_words", "n_removed", "kept", "spans"])

    return found.select("_id", "_k", "_text", "_spans").mapInArrow(rows, "_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,words:int>>").select(id_back().alias("doc_id"), "n_words", "n_removed", "kept", "spans")
