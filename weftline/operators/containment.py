"""Which texts hold which others, by a join on grams instead of a comparison of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.grams import TIERS, minimisers_of, tier_of
from weftline.operators.checkpoints import checkpointed


#: Bytes of texts whose grams are worked out at once.
_AT_ONCE = 1 << 20
#: Texts of one group, and their bytes, that are compared pair by pair where they meet; texts of larger groups meet by grams.
FEW_TEXTS, FEW_BYTES = 32, 1 << 20
#: Buckets of lines by their hash, as many as are broadcast at most.
_BUCKETS = 1 << 20


def _stretches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, data, starts, ends): the texts in stretches of about ``_AT_ONCE`` bytes, null ones as empty."""
    whole = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _AT_ONCE, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first:last] - at[first], at[first + 1 : last + 1] - at[first]
        first = last


def _gram_rows(texts: DataFrame, by_row: bool) -> DataFrame:
    """(_by, _id, _tier, _gram) of (_by, _id, _text): grams of the row's own tiers (_tiers), or of the one that each text fills."""
    kinds = dict(texts.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3) if by_row else None
            for first, data, starts, ends in _stretches(batch.column(2)):
                for tier in TIERS:
                    if by_row:
                        own = np.array([tier in x for x in asked.slice(first, len(starts)).to_pylist()])
                    else:
                        own = np.array([tier_of(int(n)) == tier for n in ends - starts])
                    if not own.any():
                        continue
                    at, grams = minimisers_of(data, starts, np.where(own, ends, starts), tier)
                    if len(grams):
                        where = pa.array(at + first)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(np.full(len(grams), tier, np.int32)), pa.array(grams)], ["_by", "_id", "_tier", "_gram"])

    read = texts.where(F.length("_text") > 0).select("_by", "_id", "_text", *(["_tiers"] if by_row else []))
    return read.mapInArrow(rows, f"_by {kinds['_by']}, _id {kinds['_id']}, _tier int, _gram long")


def contained(needles: DataFrame, hays: DataFrame, same: bool = False) -> DataFrame:
    """(_by, _needle, _hay): pairs of a text and one that contains it, of equal ``_by``.

    Both sides have (_by, _id, _text), ids unique in their ``_by``. A needle's windows have the same least grams wherever they stand, so a
    hay that holds it has all of them. Of a needle's grams the one that fewest hays have is its anchor; it meets only those hays, and is
    looked for in their texts. A needle with a gram that no hay has is in none. Empty and null texts are in none. All pairs are found: give equal texts as one row, so that
    copies of each other are not paired one by one.

    A group of one ``_by`` with ``FEW_TEXTS`` texts or less is compared pair by pair in one place, without grams. In larger ones a hay has grams only for the
    lengths of the needles of its ``_by``, and texts meet by gram, not by ``_by``: a group of any size is spread over all tasks. With
    ``same`` both sides are the same rows, and a text is not paired with itself; then one with a gram that no other text has is in none.
    """
    kind = [dict(df.dtypes)["_id"] for df in (needles, hays)]
    sides = [(hays, same, True)] if same else [(needles, True, False), (hays, False, True)]
    one, *other = [df.select("_by", "_text", *(F.when(F.lit(is_), F.col("_id")).cast(k).alias(name) for is_, k, name in zip(on, kind, ("_needle", "_hay"), strict=True)), *(F.lit(is_).alias(name) for is_, name in zip(on, ("_sought", "_held"), strict=True))) for df, *on in sides]
    rows = (one.unionByName(other[0]) if other else one).where("_by IS NOT NULL AND _text IS NOT NULL")
    # texts are not moved to count them
    counted = rows.groupBy("_by").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_text")).alias("_size"))
    many = checkpointed(counted.where((F.col("_n") > FEW_TEXTS) | (F.col("_size") > FEW_BYTES)).select("_by"))
    large = not many.isEmpty()
    few = rows.join(many, "_by", "left_anti") if large else rows
    groups = few.groupBy("_by").agg(F.collect_list(F.struct("_needle", "_hay", "_text", "_sought", "_held")).alias("_g"))
    pairs = F.flatten(F.transform(F.filter("_g", lambda x: x["_sought"] & (F.length(x["_text"]) > 0)), lambda x: F.transform(F.filter("_g", lambda y: _holds(y, x, same)), lambda y: F.struct(x["_needle"].alias("_needle"), y["_hay"].alias("_hay")))))
    near = groups.select("_by", F.inline(pairs))
    if not large:
        return near
    rest = checkpointed(rows.join(many, "_by", "left_semi"))
    return near.unionByName(_by_grams(*(rest.where(on).select("_by", F.col(name).alias("_id"), "_text") for on, name in (("_sought", "_needle"), ("_held", "_hay"))), same))


def _holds(hay: Column, needle: Column, same: bool) -> Column:
    found = hay["_held"] & F.contains(hay["_text"], needle["_text"])
    return (hay["_hay"] != needle["_needle"]) & found if same else found


def _by_grams(needles: DataFrame, hays: DataFrame, same: bool) -> DataFrame:
    """``contained`` for groups of any size."""
    tiers = needles.where(F.length("_text") > 0).select("_by", _tier(F.octet_length("_text")).alias("_tier")).groupBy("_by").agg(F.collect_set("_tier").alias("_tiers"))
    grams = _gram_rows(hays.join(tiers, "_by"), True)
    counts = grams.groupBy("_by", "_tier", "_gram").agg(F.count("*").alias("_n"))
    wanted = _gram_rows(needles, False).join(counts, ["_by", "_tier", "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    anchors = wanted.groupBy("_by", F.col("_id").alias("_needle")).agg(F.min(F.struct("_n", "_tier", "_gram")).alias("_a")).where(F.col("_a._n") > (1 if same else 0)).select("_by", "_needle", "_a._tier", "_a._gram")
    pairs = anchors.join(grams.withColumnRenamed("_id", "_hay"), ["_by", "_tier", "_gram"]).select("_by", "_needle", "_hay")
    if same:
        pairs = pairs.where("_needle <> _hay")
    small = needles.select("_by", F.col("_id").alias("_needle"), F.col("_text").alias("_short"))
    large = hays.select("_by", F.col("_id").alias("_hay"), "_text")
    return pairs.join(small, ["_by", "_needle"]).join(large, ["_by", "_hay"]).where(F.contains("_text", "_short")).select("_by", "_needle", "_hay")


def held_lines(lines: DataFrame) -> DataFrame:
    """(_doc, lines, held) of (_by, _doc, _line), each document's different lines of at least 128 bytes: how many there are, and how many of them another document of
    equal ``_by`` has, as a line or within one.

    A line that two documents have is held, whatever its text. One that a single document has can only be within another line, which has all its least
    grams: a line with a gram that no other line has is out. What is left meets other lines at its rarest gram and is looked for in
    their texts; of lines only those are moved that may be sought, by a broadcast of at most ``_BUCKETS`` numbers. Lines are told apart by 128 bits of SHA-256 over ``_by`` and the line. A null
    document holds nothing, and nothing of it is held.
    """
    tier = max(TIERS)
    by = F.coalesce(F.col("_by").cast("string"), F.lit(""))
    known = lines.withColumn("_id", F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, "_line"), 256), 1, 32))).withColumn("_seed", F.xxhash64(by))
    owners = checkpointed(known.where("_doc IS NOT NULL").groupBy("_id").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(1).to_numpy()
            for first, data, starts, ends in _stretches(batch.column(2)):
                at, found = minimisers_of(data, starts, ends, tier, 2)
                number = np.bincount(at, minlength=len(starts)).astype(np.int32)
                where = at + first
                yield pa.RecordBatch.from_arrays([pa.array(found ^ seeds[where]), batch.column(0).take(pa.array(where)), pa.array(number[at])], ["_gram", "_id", "_grams"])

    rows = known.where("_doc IS NOT NULL").select("_id", "_seed", "_line").mapInArrow(grams, "_gram long, _id binary, _grams int")
    every = W.partitionBy("_gram")
    shared = rows.select("*", F.min("_id").over(every).alias("_a"), F.max("_id").over(every).alias("_b"), F.count("*").over(every).alias("_n")).where("_a <> _b")
    recurring = checkpointed(shared.groupBy("_gram", "_id", "_grams", "_n").agg(F.lit(1)).select("_gram", "_id", "_grams", "_n"))

    whole = recurring.groupBy("_id", "_grams").agg(F.count("*").alias("_met"), F.min(F.struct("_n", "_gram")).alias("_a")).where("_met = _grams").select(F.col("_id").alias("_needle"), "_a._gram")
    needles = whole.join(owners.where("_first = _last").select(F.col("_id").alias("_needle"), F.col("_first").alias("_doc")), "_needle")
    met = needles.join(recurring.select("_gram", F.col("_id").alias("_hay")), "_gram").where("_needle <> _hay").select("_needle", "_doc", "_hay")
    others = owners.select(F.col("_id").alias("_hay"), "_first", "_last")
    pairs = checkpointed(met.join(others, "_hay").where("_first <> _doc OR _last <> _doc").select("_needle", "_doc", "_hay", "_first"))
    sought = pairs.select(F.col("_needle").alias("_id"), "_doc").unionByName(pairs.select(F.col("_hay").alias("_id"), F.col("_first").alias("_doc"))).distinct()
    # lines whose bucket has no line that is sought stay where they are
    bucket = F.pmod(F.xxhash64("_id"), F.lit(_BUCKETS)).alias("_bucket")
    near = known.select("_id", "_doc", "_line", bucket).join(F.broadcast(sought.select(bucket).distinct()), "_bucket", "left_semi")
    texts = checkpointed(near.join(sought, ["_id", "_doc"]).select("_id", "_line"))
    short, long = (texts.select(F.col("_id").alias(name), F.col("_line").alias(text)) for name, text in (("_needle", "_short"), ("_hay", "_long")))
    within = pairs.join(short, "_needle").join(long, "_hay").where(F.contains("_long", "_short")).select(F.col("_needle").alias("_id"))
    held = owners.where("_first <> _last").select("_id").unionByName(within).distinct().withColumn("_held", F.lit(1))
    told = known.select("_doc", "_id").join(held, "_id", "left")
    return told.groupBy("_doc").agg(F.count("*").alias("lines"), F.count(F.when(F.col("_doc").isNotNull(), F.col("_held"))).alias("held"))


def _tier(size: Column) -> Column:
    out = F.lit(0)
    for tier in sorted(TIERS):
        out = F.when(size >= tier, tier).otherwise(out)
    return out.cast("int")


def texts(rows: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """The (_by, _id, _text) of ``contained``."""
    return rows.select(F.struct(*by).alias("_by") if len(by) > 1 else F.col(by[0]).alias("_by"), F.col(key).alias("_id"), F.col(text).alias("_text"))
