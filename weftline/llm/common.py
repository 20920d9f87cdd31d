"""Helpers shared by the corpus operators.

Every operator reads its columns by name into names of its own that start with an underscore, so
extra input columns never clash. A null text counts as empty, a null id as ``NO_ID`` until the result.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, so that joins and orders need no null rules.
NO_ID = -(2**63)
#: Bytes of text that a task turns into arrays at a time.
CHUNK = 1 << 19
#: So many rows of a few numbers are few enough for every task to have them, and for so many tasks to write them.
FEW, FEW_TASKS = 100_000, 6
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A prime 2^31 - 1 and a base modulo it, for the part of a hash that no pattern in the text makes clash.
_PRIME, _ROOT = (1 << 31) - 1, 0x5DEECE66
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` (never null), ``_k`` (a hash of the text, to tell rows with equal ids apart) and ``_text``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_k"), text.alias("_text"))


def id_back(col: str = "_id"):
    return F.when(F.col(col) != NO_ID, F.col(col))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and has no executors of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder; its files outlive a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new name for a folder of tables under the shared one, which is deleted when the driver's program ends."""
    if not _folders:
        atexit.register(_delete_folders)
    _folders.append(f"{checkpoint_root(spark)}/tables-{uuid.uuid4().hex}")
    return _folders[-1]


_folders: list[str] = []


def _delete_folders() -> None:
    """Deletes the tables by the session's own Hadoop settings; a session that was stopped before leaves them to the folder's owner."""
    jvm, session = SparkContext._jvm, SparkSession.getActiveSession()
    if jvm is None or session is None or session.sparkContext._jsc is None or session.sparkContext._jsc.sc().isStopped():
        return
    conf = session._jsparkSession.sessionState().newHadoopConf()
    for folder in _folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cuts the lineage as ``checkpointed`` does, in compressed files: for tables with texts, and for what a loop hands to its next round.

    A checkpoint keeps the optimiser's guess of its size, which joins square from round to round until planning stalls; files have their own size.
    Where the caller has counted that there are at most ``most`` rows, and these are few, few tasks write them.
    """
    path = shared_folder(df.sparkSession)
    if most is not None and most <= FEW:
        df = df.coalesce(FEW_TASKS)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row, with one more at the end."""
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches, text: str = "_text", limit: int = CHUNK):
    """Arrow batches cut into pieces of at least one row and about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        cuts = np.unique(np.searchsorted(at, np.arange(0, at[-1] + limit, limit), side="left").clip(0, batch.num_rows))
        cuts = np.unique(np.concatenate(([0], cuts, [batch.num_rows])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
    release_memory()


def release_memory() -> None:
    """Gives what is free back to the system, Arrow's buffers and the C library's: workers wait for their next task and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 200_000)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _prime_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root modulo the prime, up and down."""
    if len(_powers.get("prime_up", ())) < n:
        size = max(n, CHUNK + 200_000)
        for name, base in (("prime_up", _ROOT), ("prime_down", pow(_ROOT, -1, _PRIME))):
            steps = np.ones(1, np.uint64)
            while len(steps) < size:  # doubling: the powers so far times the next one
                steps = np.concatenate((steps, steps * np.uint64(pow(base, len(steps), _PRIME)) % np.uint64(_PRIME)))
            _powers[name] = steps[:size]
    return _powers["prime_up"][:n], _powers["prime_down"][:n]


def _plain_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial modulo 2^64 of units[start:end]. Some texts of 1,024 units and more, such as Thue-Morse words, have equal ones by construction."""
    up, down = _power(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[start:end] for each start and end, for ranges of any length: a polynomial modulo 2^64 and one modulo a prime."""
    up, down = _prime_power(len(units) + 1)
    prime = np.uint64(_PRIME)
    total = np.zeros(len(units) + 1, np.uint64)
    if units.dtype.itemsize == 1 and len(units) < 1 << 23:  # sums of bytes times powers stay within 64 bits
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    else:
        np.cumsum((units.astype(np.uint64) % prime + np.uint64(1)) * up[:-1] % prime, out=total[1:])
    sound = (total[ends] - total[starts]) % prime * down[starts] % prime
    return mixed(_plain_hashes(units, starts, ends) + (sound + np.uint64(1)) * _BASE)


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n (a few) consecutive units; runs that cross documents are left in for the caller to skip."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(units) - n + 1)
    return _plain_hashes(units, starts, starts + n)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs of bytes that ``inside`` marks) and, for each document, its first word."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(mask[1:-1] & (~mask[:-2] | first[:-1]))
    ends = np.flatnonzero(mask[1:-1] & (~mask[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def marks(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: Words are runs of bytes other than these.
SPACES = marks(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words for comparing texts: ASCII white space and punctuation part them.
PLAIN = marks(bytes(c for c in range(128) if not chr(c).isalnum()))


def window_runs(grams: np.ndarray, bounds: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits the windows of k units of each document into runs that share their least m-gram (leftmost of equal ones).

    Equal windows have equal least m-grams, wherever they stand. Returns for each run its document, its first and last
    window start, and the hash of the m-gram, the run's anchor.
    """
    units = int(bounds[-1])
    edge = np.zeros(units + 1, np.int32)
    has = np.diff(bounds) >= k
    np.add.at(edge, bounds[:-1][has], 1)
    np.add.at(edge, bounds[1:][has] - k + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    none = np.zeros(0, np.int64)
    if not valid.any():
        return none, none, none, np.zeros(0, np.uint64)
    width, least, step = k - m + 1, (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), 1
    n = len(grams) - width + 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:n], least[width - step : width - step + n])
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = valid[:n]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    last = ok.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last)
    return np.searchsorted(bounds, starts, side="right") - 1, starts, ends, grams[at[starts]]
