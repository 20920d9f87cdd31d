"""The trie of conversation prefixes: ternary search trees over numbered turns, one for each range of sequences, joined at their edges."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import saved, shuffle_partitions
from weftline.llm.lookup import looked_up

#: Turns that one tree holds, about; the number of trees grows with the input.
SHARD = 250_000
#: Characters of a conversation id list that are joined before they meet, about.
PIECE = 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
NONE = hashlib.sha256(b"").hexdigest()

PART = (
    "edge boolean, conv_id long, depth long, parent long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved long, ends string, "
    "first_ids array<long>, first_words array<long>, last_ids array<long>, last_words array<long>"
)
DELTA = "edge boolean, conv_id long, depth long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved long, ends string"


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, turn, id, words): turns by number; numbers follow the order of (role, text), and equal turns have equal ones.

    ``rows`` has conv, turn, role and text, none but turn null. The dictionary is made of distinct turns, counted before the shuffle, and
    sorted over all tasks; a turn finds its number by the SHA-256 of what it says, and those of a hot turn by a broadcast.
    """
    said = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("_h")
    distinct = rows.groupBy(said, "role", "text").agg(F.count("*").alias("_n"))
    ranged = distinct.repartitionByRange(shuffle_partitions(rows.sparkSession), "role", F.substring("text", 1, 256)).sortWithinPartitions("role", "text")
    known = saved(ranged.select("_h", "_n", F.monotonically_increasing_id().alias("id"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    return looked_up(rows.select("conv", "turn", said), known, ["_h"], "_n", known.agg(F.sum("_n")).first()[0] or 0).select("conv", "turn", "id", "words")


def rebuilt(turns: DataFrame, group: int, most: int) -> DataFrame:
    """(conv, ids, words): each conversation with its first turns taken from the first one of its group of ``group`` ids.

    So many turns as the unsigned CRC-32 of the decimal id modulo ``most`` says; fewer if the other one has fewer, none if there is none.
    """
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("_t"))
    own = own.select("conv", (F.col("conv") - F.col("conv") % group).alias("_base"), (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("_head"), "_t")
    heads = own.where("conv = _base").select("_base", F.slice("_t", 1, most - 1).alias("_b"))
    none = F.array().cast(own.schema["_t"].dataType)
    both = F.concat(F.slice(F.coalesce("_b", none), F.lit(1), F.col("_head")), F.slice("_t", F.col("_head") + 1, F.greatest(F.size("_t"), F.lit(1))))
    done = own.join(heads, "_base", "left").select("conv", both.alias("_s"))
    return done.select("conv", F.transform("_s", lambda x: x["id"]).alias("ids"), F.transform("_s", lambda x: x["words"]).alias("words"))


def end_digests(rows: DataFrame) -> DataFrame:
    """(_k, ends): SHA-256 of the conversation ids of each ``_k`` in order, joined by commas.

    Ids of a large group are joined piece by piece over all tasks; what meets in one task streams through its digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or size > PIECE):
                    out.append((key, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    key, first = k, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["_k", "_first", "_piece"])
                out = []
        if held:
            out.append((key, first, ",".join(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["_k", "_first", "_piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["_k", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["_k", "ends"])

    n = shuffle_partitions(rows.sparkSession)
    some = rows.select("_k", "conv").repartitionByRange(n, "_k", "conv").sortWithinPartitions("_k", "conv").mapInArrow(pieces, "_k string, _first long, _piece string")
    return some.repartition(n, "_k").sortWithinPartitions("_k", "_first").select("_k", "_piece").mapInArrow(digests, "_k string, ends string")


def step(key: bytes, turn: int) -> bytes:
    """The key of a prefix with one more turn."""
    return hashlib.sha256(key + turn.to_bytes(8, "big")).digest()


class Tree:
    """A ternary search tree of turn ids. Node 0 is the empty prefix; another stands for the prefix that ends in its id.

    ``low`` and ``high`` lead to siblings, ``down`` to a node's children, ``up`` to the prefix without the last turn.
    """

    def __init__(self) -> None:
        self.id, self.words, self.depth, self.up = [-1], [0], [0], [-1]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def _add(self, up: int, turn: int, words: int) -> int:
        for column, value in ((self.id, turn), (self.words, words), (self.depth, self.depth[up] + 1), (self.up, up), (self.low, -1), (self.high, -1), (self.down, -1)):
            column.append(value)
        return len(self.id) - 1

    def insert(self, turns: list[int], words: list[int]) -> int:
        at = 0
        for turn, n in zip(turns, words, strict=True):
            links, t = self.down, at
            while links[t] >= 0:
                t = links[t]
                if turn == self.id[t]:
                    break
                links = self.low if turn < self.id[t] else self.high
            else:
                links[t] = self._add(at, turn, n)
                t = links[t]
            at = t
        return at

    def order(self) -> list[int]:
        """All nodes, each before those below it, siblings in order of their ids."""
        found, stack = [0], [(self.down[0], False)]
        while stack:
            t, passed = stack.pop()
            if passed:
                found.append(t)
            elif t >= 0:
                stack += [(self.high[t], False), (self.down[t], False), (t, True), (self.low[t], False)]
        return found


def tree_of(sequences: list[list[int]], words: list[list[int]]) -> tuple[Tree, list[int]]:
    """The tree of sorted sequences, the middle one of each range first, and each sequence's last node."""
    tree, last, ranges = Tree(), [0] * len(sequences), [(0, len(sequences))]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            last[mid] = tree.insert(sequences[mid], words[mid])
            ranges += [(mid + 1, b), (a, mid)]
    return tree, last


def shard_parts(sequences: list[list[int]], words: list[list[int]], sizes: list[int], firsts: list[int], ends: list[str]) -> list[tuple]:
    """Rows of PART: what a shard of sorted, distinct sequences says of each of its prefixes.

    Prefixes on the paths of the first and the last sequence, which other shards may have too, are edges and have a key. The last
    row holds those two sequences.
    """
    tree, last = tree_of(sequences, words)
    n = len(tree.id)
    members, conv, children, leaves, saving, digest = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [None] * n
    for at, size, first, end in zip(last, sizes, firsts, ends, strict=True):
        members[at], conv[at], digest[at] = size, first, end
    order = tree.order()
    for t in reversed(order):
        leaves[t] = leaves[t] or 1
        saving[t] += (members[t] - 1) * tree.words[t]
        up = tree.up[t]
        if up >= 0:
            members[up] += members[t]
            conv[up] = conv[t] if conv[up] is None else min(conv[up], conv[t])
            children[up] += 1
            leaves[up] += leaves[t]
            saving[up] += saving[t]
    keys = {0: b""}
    for at in (last[0], last[-1]):
        path = []
        while at:
            path.append(at)
            at = tree.up[at]
        for t in reversed(path):
            keys[t] = step(keys[tree.up[t]], tree.id[t])
    rest = (None,) * 4
    out = []
    for t in order:
        edge, up = t in keys, tree.up[t]
        inner = up >= 0 and up not in keys
        out.append((edge, conv[t], tree.depth[t], conv[up] if inner else None, keys.get(t), None if inner or up < 0 else keys[up], members[t], children[t], leaves[t], saving[t], digest[t], *rest))
    return [*out, (None,) * 11 + (sequences[0], words[0], sequences[-1], words[-1])]


def edge_deltas(before: list[int], first: list[int], words: list[int]) -> list[tuple]:
    """Rows of DELTA: what two shards count twice, of which one ends with ``before`` and the next starts with ``first``.

    Of a common prefix, the child within it is one child and its turn is shared once more; if all of ``before`` is, it is no leaf.
    """
    common = next((i for i, (a, b) in enumerate(zip(before, first, strict=False)) if a != b), min(len(before), len(first)))
    keys = [b""]
    for turn in first[:common]:
        keys.append(step(keys[-1], turn))
    extended, saving, out = -int(common == len(before)), 0, []
    for d in range(common, -1, -1):
        saving += words[d - 1] if d else 0
        out.append((True, None, d, keys[d], None, 0, -int(d < common), extended, saving, None))
    return out


def prefix_nodes(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct prefix of (conv, ids, words)."""
    spark = seqs.sparkSession
    held = saved(seqs.withColumn("_k", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)))
    turns = held.agg(F.sum(F.size("ids"))).first()[0] or 0
    groups = held.groupBy("_k", "ids", "words").agg(F.count("*").alias("_n"), F.min("conv").alias("_first")).join(end_digests(held), "_k")
    shards = max(shuffle_partitions(spark), math.ceil(turns / SHARD))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        rows = shard_parts(*(table.column(c).to_pylist() for c in ("ids", "words", "_n", "_first", "ends")))
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, r, strict=True)) for r in rows[i : i + 20_000]], PARTS)

    def deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["before"] is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(DELTAS.names, x, strict=True)) for x in edge_deltas(r["before"], r["first_ids"], r["first_words"])], DELTAS)

    found = saved(groups.select("ids", "words", "_n", "_first", "ends").repartitionByRange(shards, "ids").sortWithinPartitions("ids").mapInArrow(parts, PART))
    # one row for each shard
    met = found.where("edge IS NULL").select("first_ids", "first_words", F.lag("last_ids").over(W.orderBy("first_ids")).alias("before"))
    edges = found.where("edge").select(*DELTAS.names).unionByName(met.mapInArrow(deltas, DELTA))
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")}
    merged = saved(edges.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *total.values(), F.max("ends").alias("ends")))
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"), F.col("n_children").alias("_weight"))
    cols = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    below = found.where("NOT edge AND parent_key IS NOT NULL").select("parent_key", *cols).unionByName(merged.where("depth > 0").select("parent_key", *cols))
    told = looked_up(below, known, ["parent_key"], "_weight", merged.agg(F.sum("n_children")).first()[0] or 0).drop("parent_key")
    root = merged.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    done = told.unionByName(root.select(*cols, "parent")).unionByName(found.where("NOT edge AND parent_key IS NULL").select(*cols, "parent"))
    return done.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))


#: Arrow schemas of PART and DELTA.
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
PARTS, DELTAS = (pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in text.split(", ")]) for text in (PART, DELTA))


def conversation_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, most: int = 4) -> DataFrame:
    """Each distinct prefix of the rebuilt conversations with its members, children, leaves and the words that sharing it saves.

    Turns are ordered by ``turn_col`` (null first), of equal ones by role and text; a null role or text is empty; rows without a
    conversation belong to none and are left out; a repeated row is a further turn; columns of other names don't matter; an empty
    table has no prefixes. ``rebuilt`` says what is taken from other conversations.

    A tree holds about ``SHARD`` turns, but never less than one sequence: a task needs memory for the longest conversation's ids.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).where("conv IS NOT NULL")
    return prefix_nodes(rebuilt(numbered(read), group, most))
