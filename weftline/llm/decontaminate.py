"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import PLAIN, chunks, column, id_back, keyed, mixed, range_hashes, utf8, word_spans

#: Fixed masks: a 1 is a word that must agree, a 0 one that may differ. Wherever up to 3 words of 13 differ, one of them still fits.
MASKS = ("111111", "11101011", "1010011011", "1100100111", "11001010011", "110100011001")
#: A run of so many aligned words (the whole item, if it is shorter) must agree in this share of them.
WINDOW, SHARE = 13, 0.75
#: Bytes of benchmark text that a task holds at a time; a larger benchmark is taken in several blocks, each against all rows.
BLOCK = 16 << 20
_STEPS = mixed(np.arange(1, 64, dtype=np.uint64))


def masks_of(width: int) -> tuple[str, ...]:
    """Masks for items of so many words (13 for all longer ones), one of which fits however the words that may differ lie.

    A shorter item is cut into two runs more than words of it may differ, and each two of them make a mask of its whole length.
    """
    if width >= WINDOW:
        return MASKS
    spare = width - math.ceil(SHARE * width)
    if not spare:
        return ("1" * width,)
    run = [j * (spare + 2) // width for j in range(width)]
    return tuple("".join("01"[r in pair] for r in run) for pair in combinations(range(spare + 2), 2))


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of a string column, and each row's first word."""
    data, at = utf8(pc.utf8_lower(col))
    starts, ends, bounds = word_spans(data, at, PLAIN)
    return range_hashes(data, starts, ends), bounds


def _seeds(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the mask fits into one row, and the hash of the words under it."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j : j + n] * _STEPS[j]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return at, mixed(total[at])


class Block:
    """Part of the benchmark, ready to be looked up: words, items and, for each mask of each width of item, sorted seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.bounds = _words(pa.array([t for _, t in items], pa.string()))
        self.item = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        self.masks = []
        widths = np.minimum(WINDOW, np.diff(self.bounds))
        for width in np.unique(widths[widths > 0]).tolist():
            for mask in masks_of(width):
                at, seed = _seeds(self.words, self.bounds, mask)
                own = widths[self.item[at]] == width
                at, seed = at[own], seed[own]
                order = np.argsort(seed)
                some = np.zeros(1 << 20, bool)
                some[(seed >> np.uint64(44)).astype(np.int64)] = True
                self.masks.append((mask, seed[order], at[order].astype(np.int32), some))

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(row, item, first word, words, agreeing words) of the best verified overlap of each row and item."""
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = [np.zeros((0, 3), np.int64)]
        for mask, seeds, places, some in self.masks:
            at, seed = _seeds(words, bounds, mask)
            maybe = np.flatnonzero(some[(seed >> np.uint64(44)).astype(np.int64)])
            at, seed = at[maybe], seed[maybe]
            low, high = np.searchsorted(seeds, seed, "left"), np.searchsorted(seeds, seed, "right")
            times = high - low
            place = places[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            at = np.repeat(at, times)
            found.append(np.stack([rows[at], self.item[place], at - (place - self.bounds[self.item[place]])], 1))
        # a hit's diagonal is where the item's first word would stand; each is verified once
        hits = np.unique(np.concatenate(found), axis=0)
        if not len(hits):
            return np.zeros((0, 5), np.int64)
        row, item, zero = hits.T
        first = np.maximum(zero, bounds[row])
        last = np.minimum(zero + np.diff(self.bounds)[item], bounds[row + 1])
        size = last - first
        start = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(start, size)
        same = words[np.repeat(first, size) + inner] == self.words[np.repeat(self.bounds[item] + first - zero, size) + inner]
        total = np.concatenate(([0], np.cumsum(same)))
        width = np.minimum(WINDOW, np.diff(self.bounds)[item])
        out: dict[tuple[int, int], tuple] = {}
        for r, i, a, s, n, w in zip(row.tolist(), item.tolist(), first.tolist(), start.tolist(), size.tolist(), width.tolist(), strict=True):
            if n < w:
                continue
            good = np.flatnonzero(total[s + w : s + n + 1] - total[s : s + n - w + 1] >= math.ceil(SHARE * w))
            if len(good):
                b, e = int(good[0]), int(good[-1]) + w
                value = (int(total[s + e] - total[s + b]), -(a + b - bounds[r]), e - b)
                out[r, i] = max(out.get((r, i), value), value)
        return np.array([(r, i, -a, n, m) for (r, i), (m, a, n) in out.items()], np.int64).reshape(-1, 5)


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's blocks as broadcasts, one after another; each is of a proven size."""
    items = keyed(benchmark, id_col, text_col).select("_id", "_text").distinct()
    size = items.select(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, math.ceil(2 * size / BLOCK))
    context = benchmark.sparkSession.sparkContext
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == b)
        yield context.broadcast(Block([(r[0], r[1]) for r in part.orderBy("_id", "_text").collect()]))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which documents contain which benchmark items, allowing for substituted words.

    Words are compared in lower case without ASCII punctuation. A seed hit fixes how a document and an item are aligned; the
    overlap counts if, in some run of 13 aligned words (the item's length, if less), at least three quarters agree. The masks
    miss no such run, whichever words differ; items of up to 3 words must agree whole, so one of a common word is in most texts. Returns
    ``doc_id, item_id, start`` (first word), ``n_words`` and ``n_same`` of the best overlap, one row for each pair. Null or
    empty texts and items overlap nothing; null ids stay null; repeated rows give
    repeated results; an empty benchmark or table gives no rows.
    """
    source, out = keyed(docs, id_col, text_col).select("_id", "_text"), None
    for block in blocks(benchmark, item_col, item_text_col):

        def rows(batches, block=block):
            for batch in chunks(batches):
                words, bounds = _words(batch.column(batch.schema.get_field_index("_text")))
                got = block.value.overlaps(words, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(column(batch, "_id")[got[:, 0]]), pa.array(block.value.ids[got[:, 1]]), *(pa.array(got[:, c]) for c in (2, 3, 4))], ["_id", "_item", "start", "n_words", "n_same"])

        part = source.mapInArrow(rows, "_id long, _item long, start long, n_words long, n_same long")
        out = part if out is None else out.union(part)
    return out.select(id_back().alias("doc_id"), id_back("_item").alias("item_id"), "start", "n_words", "n_same")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that overlap no benchmark item; no shuffle."""
    for block in blocks(benchmark, item_col, item_text_col):

        def rows(batches, block=block):
            for batch in chunks(batches, text_col):
                words, bounds = _words(batch.column(batch.schema.get_field_index(text_col)).fill_null(""))
                keep = np.ones(batch.num_rows, bool)
                keep[block.value.overlaps(words, bounds)[:, 0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


