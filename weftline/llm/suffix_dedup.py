"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

The strings to compare are the runs at repeated anchors (see repeats.py). Their transforms are taken over an alphabet of
q-byte grams: the text of a string is its q phases, each a sequence of grams q bytes apart, so that a common prefix of
k / q symbols is a common string of k bytes. Each shard of strings is sorted by itself; the merge never compares suffixes
but refines the order in which the shards' transforms interleave, one symbol deeper a round, k / q rounds in all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, column, gram_hashes, id_back, keyed, mixed, utf8, window_runs
from weftline.llm.repeats import anchor_rows, at_one_place, candidate_runs, covered, own_spans, run_rows, span_batch, with_spans

LENGTH, GRAM, SYMBOL, SHARDS = 200, 32, 25, 2
#: Bytes of distinct strings that are merged at a time; a larger group is split by a second anchor.
MERGE = 1 << 20


class Strings:
    """Strings laid end to end as nodes: the suffixes of each, and q empty ones, one for each phase."""

    def __init__(self, strings: list[bytes], q: int):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        nodes, self.q = int(self.at[-1]), q
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), self.sizes + 1)
        self.left = np.repeat(self.at[1:] - 1, self.sizes + 1) - np.arange(nodes)  # bytes from here to the string's end
        full = np.flatnonzero(self.left >= q)
        self.symbol = np.zeros(nodes, np.int64)
        self.symbol[full] = numbered(gram_hashes(data, q)[full]) + 1
        self.before = np.zeros(nodes, np.int64)
        self.before[q:] = np.where(self.left[q:] + q <= np.repeat(self.sizes, self.sizes + 1)[q:], self.symbol[:-q], 0)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Equal hashes alike by numbers from 0; their order is free. Sorts the upper bits with places packed below, if those tell all apart."""
    if len(hashes) < 1 << 21:
        low = np.uint64((1 << 21) - 1)
        key = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
        key.sort()
        order = (key & low).astype(np.int64)
        key >>= np.uint64(21)
        differs, own = key[1:] != key[:-1], hashes[order]
        if np.array_equal(differs, own[1:] != own[:-1]):
            out = np.zeros(len(hashes), np.int64)
            out[order[1:]] = np.cumsum(differs)
            return out
    return np.unique(hashes, return_inverse=True)[1]


def ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by (high, low), and each place's rank there, equal pairs alike. Few enough go through one sort of packed numbers."""
    if len(high) < 1 << 21:
        key = high << 42 | low << 21 | np.arange(len(high))
        key.sort()
        order = key & ((1 << 21) - 1)
        key >>= 21
    else:
        key = high << 32 | low
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.zeros(len(key), np.int64)
    np.cumsum(key[1:] != key[:-1], out=rank[1:])
    return order, rank


def shard_transform(text: Strings, first: int, last: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a shard (nodes first to last) in order of ``depth`` symbols or more (by prefix doubling), and the symbols before them."""
    rank, left, step = text.symbol[first:last], text.left[first:last], 1
    order, place = ordered(np.unique(rank, return_inverse=True)[1], np.zeros(last - first, np.int64)) if depth == 1 else (None, None)
    while step < depth:
        ahead = np.zeros(last - first, np.int64)
        over = step * text.q
        ahead[:-over] = np.where(left[:-over] >= over, rank[over:], 0)
        order, place = ordered(rank, ahead)
        rank = np.empty(last - first, np.int64)
        # the empty suffixes, and those of less than a symbol, are the first place's and stay 0
        rank[order] = place
        step *= 2
    return order + first, text.before[first:last][order]


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Iterative interleave refinement: for each place in the merged order its shard, and the number of its interval.

    Round t places every symbol by the order of round t - 1, stably, and so orders all suffixes by t symbols. Neighbours
    stay in one interval while their common prefix has t symbols: an interval's boundary appears in the round that first
    sees a difference, which gives the length of the common prefix there.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.int8), [len(t) for t in transforms])
    interval = np.zeros(len(shard), np.int32)
    slots = np.arange(len(shard), dtype=np.int64)
    transforms = [t << 32 for t in transforms]
    key = np.empty(len(shard), np.int64)
    differs = np.ones(len(shard), bool)
    for _ in range(depth):
        for s, transform in enumerate(transforms):
            key[shard == s] = transform
        key |= slots
        key.sort()
        order = key & 0xFFFFFFFF
        key >>= 32
        shard, old = shard[order], interval[order]
        old[: np.searchsorted(key, 0, "right")] = 0
        differs[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        interval = np.cumsum(differs, dtype=np.int32)
    return shard, interval - 1


def repeated_starts(strings: list[bytes], weights: list[int], k: int = LENGTH, q: int = SYMBOL, shards: int = SHARDS) -> list[np.ndarray]:
    """For each string, where strings of k bytes start that occur at least twice, a string counted ``weight`` times."""
    text, depth = Strings(strings, q), k // q
    cuts = text.at[[len(strings) * s // shards for s in range(shards + 1)]]
    orders, transforms = zip(*(shard_transform(text, int(a), int(b), depth) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b), strict=True)
    shard, interval = merged(list(transforms), depth)
    node = np.empty(len(shard), np.int64)
    for s, order in enumerate(orders):
        node[shard == s] = order
    whole = text.left[node] >= k
    node, interval = node[whole], interval[whole]
    times = np.bincount(interval, weights=np.asarray(weights)[text.string[node]]) if len(node) else np.zeros(0)
    hits = np.zeros(len(text.symbol), bool)
    hits[node[times[interval] >= 2]] = True
    return [np.flatnonzero(hits[a:b]) for a, b in zip(text.at[:-1], text.at[1:], strict=True)]


def _runs(data: np.ndarray, bounds: np.ndarray, k: int, salt: int = 0):
    grams = gram_hashes(data, GRAM)
    return window_runs(mixed(grams ^ np.uint64(salt)) if salt else grams, bounds, k, GRAM)


def group_starts(strings: list[bytes], weights: list[int], k: int, salt: int = 1) -> list[np.ndarray]:
    """repeated_starts in bounded memory: too many strings are cut at second anchors, which part what cannot be equal."""
    if len(strings) == 1 and weights[0] >= 2:
        return [np.arange(len(strings[0]) - k + 1)]
    if sum(map(len, strings)) <= MERGE or salt > 4:
        return repeated_starts(strings, weights, k)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    owner, first, last, anchor = _runs(np.frombuffer(b"".join(strings), np.uint8), bounds, k, salt)
    groups: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for o, a, b, key in zip(owner.tolist(), (first - bounds[owner]).tolist(), (last - bounds[owner]).tolist(), anchor.tolist(), strict=True):
        groups.setdefault(key, {}).setdefault(strings[o][a : b + k], []).append((o, a))
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in strings]
    batch: dict[bytes, list[tuple[int, int]]] = {}

    def settle():
        for places, hits in zip(batch.values(), group_starts(list(batch), [sum(weights[o] for o, _ in v) for v in batch.values()], k, salt + 1) if batch else (), strict=True):
            for o, a in places:
                found[o].append(hits + a)
        batch.clear()

    for group in groups.values():
        if sum(weights[o] for places in group.values() for o, _ in places) < 2:
            continue
        if batch and sum(map(len, batch)) + sum(map(len, group)) > MERGE:
            settle()
        for text, places in group.items():
            batch.setdefault(text, []).extend(places)
    settle()
    return [np.unique(np.concatenate(x)) for x in found]


def repeated_spans(runs: DataFrame, k: int) -> DataFrame:
    """(_id, _k, _start, _len) of the bytes in repeated strings of k bytes."""

    def rows(batches):
        places: dict[bytes, list[tuple[int, int, list[int]]]] = {}  # the distinct runs of whole groups, and where they stand
        group: dict[bytes, list[tuple[int, int, list[int]]]] = {}
        anchor, size = None, 0

        def settle():
            out: list[tuple] = []
            if places:
                for (text, at), starts in zip(places.items(), group_starts(list(places), [sum(len(x) for _, _, x in v) for v in places.values()], k), strict=True):
                    if len(starts):
                        gaps = np.flatnonzero(starts[1:] - starts[:-1] > k)
                        spans = [(int(starts[0]), int(starts[-1]) + k)] if not len(gaps) else list(zip([int(starts[0]), *starts[gaps + 1].tolist()], [*(starts[gaps] + k).tolist(), int(starts[-1]) + k], strict=True))
                        out.extend((i, key, start + a, b - a) for i, key, own in at for start in own for a, b in spans)
            places.clear()
            return span_batch(out)

        def close():
            # a run that stands alone in its group is repeated as a whole and needs no merge; many such settle at once
            nonlocal size
            if len(group) > 1 or any(len(x) > 1 for at in group.values() for _, _, x in at) or sum(map(len, group.values())) > 1:
                for text, at in group.items():
                    places.setdefault(text, []).extend(at)
                    size += len(text)
            group.clear()

        for batch in batches:
            for a, i, key, starts, run in run_rows(batch):
                if a != anchor:
                    close()
                    anchor = a
                    if size >= MERGE // 2:
                        yield settle()
                        size = 0
                group.setdefault(run, []).append((i, key, starts))
        close()
        yield settle()

    return at_one_place(runs).mapInArrow(rows, "_id long, _k long, _start int, _len int")


def repeated_bytes(docs: DataFrame, k: int = LENGTH) -> DataFrame:
    """``keyed`` documents with ``_spans``: the byte spans covered by strings of k bytes that occur more than once."""

    def runs_of(batch):
        data, bounds = utf8(batch.column(batch.schema.get_field_index("_text")))
        return (data, bounds), _runs(data, bounds, k)

    def units_of(units, first, last):
        data, bounds = units
        return data, bounds, first, last + k

    anchors = anchor_rows(docs, runs_of)
    repeated = anchors.groupBy("_anchor").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_anchor")
    wanted = anchors.join(repeated, "_anchor").groupBy("_id").agg(F.collect_list("_anchor").alias("_anchors"))
    return with_spans(docs, repeated_spans(candidate_runs(docs, wanted, runs_of, units_of), k))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Cuts out of each document every byte covered by a string of ``length`` bytes that starts anywhere else too.

    Texts are UTF-8; matches never cross documents and may overlap; strings are judged on the input. Returns ``doc_id, n_bytes,
    n_removed, n_spans`` (maximal removed runs), ``kept`` (binary: a cut may fall inside a character) and ``spans``. Null
    texts are empty; rows with equal ids are documents of their own, so a repeated row repeats its strings; an empty table
    gives no rows. ``length`` must be a multiple of 25 by a power of two, such as 100, 200 or 400.
    """
    if length % SYMBOL or (length // SYMBOL) & (length // SYMBOL - 1) or length <= GRAM:
        raise ValueError("length must be 25 times a power of two, 50 at least")
    found = repeated_bytes(keyed(docs, id_col, text_col), length)

    def rows(batches):
        for batch in chunks(batches):
            data, bounds = utf8(batch.column(batch.schema.get_field_index("_text")))
            out = ([], [], [], [], [])
            for i, (at, size) in enumerate(own_spans(batch)):
                own = data[bounds[i] : bounds[i + 1]]
                gone = covered(len(own), at, size)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                for to, value in zip(out, (len(own), int(gone.sum()), len(edge) // 2, own[~gone].tobytes(), [{"start": x, "bytes": y - x} for x, y in zip(edge[::2], edge[1::2], strict=True)]), strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "_id")), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return found.select("_id", "_k", "_text", "_spans").mapInArrow(rows, "_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,bytes:int>>").select(id_back().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "spans")
