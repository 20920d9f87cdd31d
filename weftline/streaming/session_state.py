"""Where each segment of a session stands, kept from batch to batch, and carried over from a snapshot when a stream starts anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Version of a snapshot's form. Older ones that can still be read, and this one.
VERSION, READABLE = 2, (1, 2)
PLACED = "session long, id string, seq long, idx long, tokens long, fresh boolean, offered long"
SNAPSHOT = "session long, version int, order array<string>, segments array<struct<id: string, tokens: long>>, cursor long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Placing(StatefulProcessor):
    """Gives each new id of a session the next position; a known id keeps its own and takes new tokens.

    State: a map from id to position, so that a batch reads only the ids that it has, and a value with the number of positions given. Neither
    is read or written whole, however long a session gets.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "id string", "idx long")
        self.count = handle.getValueState("count", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        ids = [i for order in initialState["order"] for i in order]
        for idx, i in enumerate(ids):
            self.places.updateValue((i,), (idx,))
        self.count.update((len(ids),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows)).sort_values(["seq", "id"], kind="stable")
        n = self.count.get()[0] if self.count.exists() else 0
        idx, fresh = [], []
        for i in whole["id"]:
            new = not self.places.containsKey((i,))
            if new:
                self.places.updateValue((i,), (n,))
                n += 1
            idx.append(n - 1 if new else self.places.getValue((i,))[0])
            fresh.append(new)
        self.count.update((n,))
        out = pd.DataFrame({"session": key[0], "id": whole["id"].to_numpy(), "seq": whole["seq"].to_numpy(), "idx": idx, "tokens": whole["tokens"].to_numpy(), "fresh": fresh})
        yield out.assign(offered=[min(i, self.window) if f else 0 for i, f in zip(idx, fresh, strict=True)])

    def close(self) -> None:
        pass


def placed(rows: DataFrame, start: DataFrame | None = None, window: int = 16) -> DataFrame:
    """(session, id, seq, idx, tokens, fresh, offered) of each row (session, id, seq, tokens), a table's or a stream's, in order of seq within a batch.

    ``fresh`` rows are the first of their id; ``offered`` is how many pairs their window has. ``start`` is a checked snapshot: its sessions go on from there. Rows of a
    batch of one session are handled in one task, which holds them; what the session had before stays in the state store.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # maps need a store with column families
    _ = rows.sparkSession.streams.active  # a table's rows use the state store too, which a session starts with its streams
    begun = None if start is None else start.select("session", "order").groupBy("session")
    keyed = rows.select("session", "id", F.col("seq").cast("long").alias("seq"), F.col("tokens").cast("long").alias("tokens")).groupBy("session")
    return keyed.transformWithStateInPandas(Placing(window), PLACED, "Append", "None", begun)


def snapshot(out: DataFrame, cursors: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The snapshot (session, version, order, segments, cursor) of all that ``placed`` has returned, after ``start``.

    ``out`` may hold an id more than once: its last row by ``seq`` says its tokens. ``cursors`` (session, cursor): up to where rows are
    settled; sessions without one are at 0.
    """
    rows = out.select("session", "id", "idx", "tokens", F.col("seq").alias("_b"))
    if start is not None:
        before = start.select("session", F.posexplode("segments").alias("_i", "_s")).select("session", "_s.id", F.lit(None).cast("long").alias("idx"), "_s.tokens", F.lit(None).cast("long").alias("_b"))
        order = start.select("session", F.posexplode("order").alias("_p", "id")).select("session", "id", F.col("_p").cast("long").alias("_at"))
        rows = rows.unionByName(before.join(order, ["session", "id"], "left").select("session", "id", F.col("_at").alias("idx"), "tokens", "_b"))
    last = rows.groupBy("session", "id").agg(F.min("idx").alias("idx"), F.max(F.struct("_b", "tokens")).getField("tokens").alias("tokens"))
    lists = last.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "tokens"))).alias("_l"))
    read = lists.join(cursors.select("session", "cursor"), "session", "left")
    return read.select("session", F.lit(VERSION).alias("version"), F.transform(F.filter("_l", lambda x: x["idx"].isNotNull()), lambda x: x["id"]).alias("order"), F.transform("_l", lambda x: F.struct(x["id"].alias("id"), x["tokens"].alias("tokens"))).alias("segments"), F.coalesce("cursor", F.lit(0)).cast("long").alias("cursor"))


def checked(snapshots: DataFrame) -> DataFrame:
    """Snapshots that can be gone on from, with ``faults`` (array): what was put right.

    ``version``: not one of ``READABLE``; the session starts empty. ``order``: ids of no segment are left out. ``twice``: of an id named twice the first place counts.
    ``unplaced``: segments without a place, which stay so. ``cursor``: one outside the order is moved to its end.
    """
    known = F.col("version").isin(*READABLE)
    none = F.array().cast("array<string>")
    ids = F.transform(F.coalesce("segments", F.array().cast("array<struct<id: string, tokens: long>>")), lambda s: s["id"])
    whole = F.coalesce("order", none)
    held = F.filter(whole, lambda i: F.array_contains(ids, i))
    order = F.when(known, F.array_distinct(held)).otherwise(none)
    end = F.size(order).cast("long")
    cursor = F.least(F.greatest(F.coalesce("cursor", F.lit(0)).cast("long"), F.lit(0).cast("long")), end)
    note = lambda test, name: F.when(test, F.lit(name))
    faults = F.array_compact(
        F.array(
            note(~F.coalesce(known, F.lit(False)), "version"), note(known & (F.size(held) < F.size(whole)), "order"), note(known & (F.size(F.array_distinct(held)) < F.size(held)), "twice"),
            note(known & (F.size(F.array_except(ids, whole)) > 0), "unplaced"), note(known & (F.coalesce("cursor", F.lit(0)) != cursor), "cursor"),
        )
    )
    empty = F.array().cast("array<struct<id: string, tokens: long>>")
    return snapshots.select("session", F.lit(VERSION).alias("version"), order.alias("order"), F.when(known, F.coalesce("segments", empty)).otherwise(empty).alias("segments"), F.when(known, cursor).otherwise(0).cast("long").alias("cursor"), faults.alias("faults"))


def placed_at_once(rows: DataFrame, window: int = 16) -> DataFrame:
    """(session, id, idx, offered): what ``placed`` gives for all batches together, by a window over first rows (session, id, seq)."""
    first = rows.groupBy("session", "id").agg(F.min("seq").alias("seq"))
    idx = (F.row_number().over(W.partitionBy("session").orderBy("seq", "id")) - 1).cast("long")
    return first.withColumn("idx", idx).select("session", "id", "idx", F.least("idx", F.lit(window)).cast("long").alias("offered"))


def empty_snapshot(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SNAPSHOT)
