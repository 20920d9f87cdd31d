"""SentencePiece encoding and decoding with a shared-prefix forward pass over a trie of marked words.

A marked word is a word with the word mark (U+2581) that stands for the space before it. No piece of the vocabulary runs over
a word's end, so a text's pieces are its words' pieces. The distinct words of a batch are sorted, which makes their trie's
depth-first order, and the forward state of each prefix is kept on a stack: a word starts from the prefix that it shares with
the one before and only walks its own new characters.

For a vocabulary of log-probabilities (a unigram model) the state of a prefix is the score of its best path and where that path's
last piece begins: Viterbi's forward pass, shared by all words with the prefix.

The vocabulary at MODEL is one of merges (byte-pair encoding), for which the best path by sums of scores is not the encoding. There
the state is the last piece of the prefix's encoding: for merges ranked by score, the encoding of a prefix of pieces is a prefix
of the encoding, so exactly one piece that ends at a character continues the state before it (the two stay apart when merged
alone). The pass is the same left-to-right recursion with one surviving arc per character.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, range_hashes, release_memory, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a task keeps from batch to batch, and pairs of pieces that a worker keeps; beyond it they start anew.
KEPT_WORDS, KEPT_PAIRS = 300_000, 250_000
#: Bytes of text encoded together.
BATCH = 1 << 20
#: Rows decoded together.
DECODED_ROWS = 200
#: A longer word is encoded by plain merging, as its trie branch would share nothing.
LONG_WORD = 64
#: What a character outside a unigram vocabulary scores below its least piece, a fixed value.
UNKNOWN_PENALTY = 10.0
#: Ids from here on stand for characters that are no piece, while a word is encoded.
LONE = 1 << 22


@dataclass
class Vocabulary:
    """Pieces with their scores, the byte pieces, what each id decodes to, and whether scores rank merges (else they are log-probabilities)."""

    pieces: list[str]
    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    decoded: list[bytes]
    merges: bool = True


def load(model: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model file, on the driver; tasks get the vocabulary by broadcast (its size is fixed)."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [read.id_to_piece(i) for i in range(read.get_piece_size())]
    plain = {p: i for i, p in enumerate(pieces) if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i))}
    byte_ids = [read.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    decoded = [b"" if read.is_control(i) or read.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    scores = [read.get_score(i) for i in range(len(pieces))]
    # a model of merges scores its pieces 0, -1, -2 and so on
    merges = all(scores[i].is_integer() for i in plain.values())
    return Vocabulary(pieces, plain, scores, byte_ids, decoded, merges)


class Encoder:
    """Encodes marked words; remembers words, and which pairs of pieces stay apart."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: Every end of a piece: the piece's id if merging makes it of its own text, else -1.
        self.ends: dict[str, int] = {}
        for piece, i in vocabulary.ids.items():
            for start in range(1, len(piece)):
                self.ends.setdefault(piece[start:], -1)
            if not vocabulary.merges or self.merge(piece) == [piece]:
                self.ends[piece] = i
        self.least = min((vocabulary.scores[i] for i in vocabulary.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.apart: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.words: dict[int, int] = {}
        self.flat, self.at, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def merge(self, text: str) -> list[str]:
        """The encoding by its definition: again and again, the adjacent pair of best score, leftmost among equals.

        Pairs wait in a heap, so that a word of n characters takes n log n steps.
        """
        ids, scores, parts, n = self.v.ids, self.v.scores, list(text), len(text)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                got = ids.get(parts[i] + parts[after[i]])
                if got is not None:
                    heappush(heap, (-scores[got], i, len(parts[i]), len(parts[after[i]])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if len(parts[i]) != left or j >= n or len(parts[j]) != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def text(self, piece: int) -> str:
        return chr(piece - LONE) if piece >= LONE else self.v.pieces[piece]

    def stay_apart(self, left: int, right: int) -> bool:
        key = left << 23 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > KEPT_PAIRS:
                self.apart.clear()
            a, b = self.text(left), self.text(right)
            known = self.apart[key] = self.merge(a + b) == [a, b]
        return known

    def best_paths(self, words: list[str]):
        """Yields the pieces of the best path of each of the sorted words, depth first through their trie."""
        # for each prefix on the branch: its best path's score and last piece, and where that starts
        total, last, begins, before = [0.0], [0], [0], ""
        ends, scores = self.ends, self.v.scores
        for word in words:
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del total[shared + 1 :], last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                piece = ends.get(word[start], -1)
                best, chosen, at = total[start] + self.least, LONE + ord(word[start]), start
                while True:
                    if piece >= 0 and total[start] + scores[piece] > best:
                        best, chosen, at = total[start] + scores[piece], piece, start
                    start -= 1
                    if start < 0 or (piece := ends.get(word[start:end])) is None:
                        break
                total.append(best)
                last.append(chosen)
                begins.append(at)
            before, parts, end = word, [], len(word)
            while end:
                parts.append(last[end])
                end = begins[end]
            yield parts[::-1]

    def forward(self, words: list[str]):
        """Yields the pieces of each of the sorted words, depth first through their trie."""
        if not self.v.merges:
            yield from self.best_paths(words)
            return
        # the state of each prefix on the branch: its last piece, and where that starts
        last, begins, before = [0], [0], ""
        ends, apart = self.ends, self.stay_apart
        for word in words:
            if len(word) > LONG_WORD or MARK in word[1:]:
                yield [self.v.ids.get(p, LONE + ord(p[0])) for p in self.merge(word)]
                continue
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                piece = ends.get(word[start], -1)
                if piece < 0:
                    piece = LONE + ord(word[start])
                while piece < 0 or (start and not apart(last[start], piece)):
                    start -= 1
                    piece = ends[word[start:end]]
                last.append(piece)
                begins.append(start)
            before, parts, end = word, [], len(word)
            while end:
                parts.append(last[end])
                end = begins[end]
            yield parts[::-1]

    def learn(self, words: dict[str, int]) -> None:
        """Encodes new words, given with their keys."""
        order, out, sizes = sorted(words), [], []
        for pieces in self.forward(order):
            n = len(out)
            for p in pieces:
                if p < LONE:
                    out.append(p)
                else:
                    out.extend(self.v.byte_ids[b] for b in chr(p - LONE).encode())
            sizes.append(len(out) - n)
        first, n = len(self.words), len(order)
        if first + n + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros(max(len(self.at), n + 1), np.int64)))
        if self.used + len(out) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(out)), np.int32)))
        self.flat[self.used : self.used + len(out)] = out
        self.at[first + 1 : first + n + 1] = self.used + np.cumsum(sizes)
        self.used += len(out)
        for i, word in enumerate(order):
            self.words[words[word]] = first + i

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        # a mark in a text is what a space becomes
        data, at = utf8(pc.replace_substring(col, MARK, " "))
        space, feed, first = data == 32, data == 10, np.zeros(len(data) + 1, bool)
        first[at] = True
        cut = first[:-1].copy()
        cut[1:] |= feed[1:] | feed[:-1] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = range_hashes(data, starts, ends)
        keys[first[starts]] ^= np.uint64(0x5851F42D4C957F2D)  # the mark before the text
        some, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.words) > KEPT_WORDS:
            self.forget()
        some, raw = some.tolist(), data.tobytes()
        new = [i for i, key in enumerate(some) if key not in self.words]
        if new:
            place = where[new]
            texts = [raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
            begins = first[starts[place]].tolist()
            self.learn_all([(MARK + t if f else t, some[i]) for t, f, i in zip(texts, begins, new, strict=True)])
        word = np.array([self.words[key] for key in some], np.int64)[which] if len(some) else np.zeros(0, np.int64)
        size = self.at[word + 1] - self.at[word]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[word] - total[:-1], size)]
        return ids, total[np.searchsorted(starts, at)]

    def learn_all(self, pairs: list[tuple[str, int]]) -> None:
        """Learns words under their keys; a word may have two, as a text's first and with a space of its own."""
        fresh: dict[str, int] = {}
        again = []
        for word, key in pairs:
            if word in fresh:
                again.append((word, key))
            else:
                fresh[word] = key
        self.learn(fresh)
        for word, key in again:
            self.learn({word: key})


def decode(ids: list[int], decoded: list[bytes]) -> str:
    """The text of a list of ids: bytes of byte pieces that form no character become U+FFFD; the first space is dropped."""
    text = b"".join([decoded[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    key = hash((tuple(shared.value.pieces), tuple(shared.value.scores)))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _decoded(ids: list[list[int] | None], pieces: list[bytes]) -> pa.Array:
    return pa.array([None if x is None else decode(x, pieces) for x in ids], pa.string())


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """The input's columns and ``piece_ids``, the ids of the pieces of each text (null: empty; empty texts have none).

    The ids are those of the SentencePiece library for the model: a space is put before the text, spaces become marks, and
    characters that the vocabulary lacks become byte pieces. Repeated rows give repeated results; an empty table gives no rows.
    With ``decoded_col`` that column has what the ids decode to (see ``with_decoded``), by the worker that encodes: a task then has one
    worker instead of two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    for name, kind in ((ids_col, "ids_col"), (decoded_col, "decoded_col")):
        if name in docs.columns:
            raise ValueError(f"there is a column {name} already: name another {kind}")

    def rows(batches):
        own = _encoder(shared)
        for batch in chunks(batches, "_text", BATCH):
            ids, at = own.encode(batch.column(batch.schema.get_field_index("_text")))
            rest = [c for c in batch.schema.names if c != "_text"]
            done = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], [*rest, ids_col])
            if not decoded_col:
                yield done
                continue
            for first in range(0, done.num_rows, DECODED_ROWS):
                part = done.slice(first, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(len(rest)).to_pylist(), own.v.decoded)], [*rest, ids_col, decoded_col])
        # an idle worker holds no more than the vocabulary
        own.forget()
        release_memory()

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    read = docs.select(row.alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return read.mapInArrow(rows, f"_row {read.schema['_row'].dataType.simpleString()}, {ids_col} array<int>{f", {decoded_col} string" if decoded_col else ""}").select("_row.*", ids_col, *([decoded_col] if decoded_col else []))


def with_decoded(encoded: DataFrame, model: str = MODEL, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """The input's columns and ``decoded``, the text of its ids (null ids: null; no ids: the empty text).

    Every row is decoded by itself, so ties and repeated rows give equal results; an empty table gives no rows. A column of the
    name ``out_col`` that is there already is an error.
    """
    if out_col in encoded.columns:
        raise ValueError(f"there is a column {out_col} already: name another out_col")
    shared = encoded.sparkSession.sparkContext.broadcast(load(model).decoded)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(part.schema.get_field_index(ids_col)).to_pylist(), shared.value)], [*part.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(rows, f"{schema}, {out_col} string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids_hash`` (xxhash64 of the ids) and ``same``: whether decoding gives the text back."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    encoded = encode(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), "text", model, decoded_col="decoded")
    return encoded.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("same"))
