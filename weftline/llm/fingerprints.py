"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, id_back, keyed, shuffle_partitions

#: A section is a line. Its paragraphs end after sentence ends, or after so many characters without one.
PARAGRAPH = r"[^.!?]{1,240}[.!?]*|[.!?]+"


def fingerprint(text: Column) -> Column:
    """``root|section:paragraph,paragraph;section:...`` of a text, in lowercase hex.

    A paragraph's digest is SHA-256 of its text, a section's that of its paragraphs' digests, the root that of the sections'
    digests. The root is written whole, the branches with 16 digits: equal roots mean equal texts, and branches that differ
    locate an edit. The empty text has one empty section.
    """
    sections = F.transform(F.split(text, "\n"), lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), 0), lambda p: F.sha2(p, 256)))
    digests = F.transform(sections, lambda s: F.struct(F.sha2(F.array_join(s, ""), 256).alias("d"), F.array_join(F.transform(s, lambda p: F.substring(p, 1, 16)), ",").alias("p")))
    root = F.sha2(F.array_join(F.transform(digests, lambda s: s["d"]), ""), 256)
    return F.concat(root, F.lit("|"), F.array_join(F.transform(digests, lambda s: F.concat(F.substring(s["d"], 1, 16), F.lit(":"), s["p"])), ";"))


def paragraphs(print_: Column) -> Column:
    """The distinct paragraph digests of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, "|", -1), F.lit(r"(?<=[:,])[0-9a-f]{16}"), 0))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common paragraphs of two fingerprints over the sum of theirs; equal roots: 1. From 0 to 1."""
    x, y = paragraphs(a), paragraphs(b)
    shared = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), 1.0).otherwise(shared)


def changed_sections(a: Column, b: Column) -> Column:
    """Indexes of the sections of a that b has nowhere: where an edit of a is to be looked for."""
    own = F.transform(F.split(F.substring_index(a, "|", -1), ";"), lambda s: F.substring_index(s, ":", 1))
    other = F.transform(F.split(F.substring_index(b, "|", -1), ";"), lambda s: F.substring_index(s, ":", 1))
    return F.filter(F.transform(own, lambda s, i: F.when(~F.array_contains(other, s), i)), lambda i: i.isNotNull())


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each document; null texts count as empty, repeated rows give repeated results."""
    return keyed(docs, id_col, text_col).select(id_back().alias("doc_id"), fingerprint(F.col("_text")).alias("fingerprint"))


def following(docs: DataFrame) -> DataFrame:
    """(_id, _next): for each id of ``keyed`` documents the next smaller one; for the least, the greatest.

    Ids alone are sorted, by ranges; a range's last id is followed by the first of the next range.
    """
    ids = docs.select("_id").distinct().repartitionByRange(shuffle_partitions(docs.sparkSession), F.desc("_id")).select("_id", F.spark_partition_id().alias("_p"))
    ids = checkpointed(ids)
    ranges = ids.groupBy("_p").agg(F.max("_id").alias("_first"))
    every = W.orderBy("_p")
    ranges = ranges.select("_p", F.coalesce(F.lead("_first").over(every), F.max("_first").over(W.partitionBy())).alias("_after"))  # a row for each range
    inside = ids.withColumn("_n", F.lead("_id").over(W.partitionBy("_p").orderBy(F.desc("_id"))))
    return inside.join(ranges, "_p").select("_id", F.coalesce("_n", "_after").alias("_next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text and the next document, by descending id (after the last: the first).

    The last floor(n / 3) code points are replaced by the first as many (or all) of the next document. Rows with equal ids are
    edited alike, with the next smaller id; of several rows with that id, the one of least text is taken. Null ids come
    last. Returns ``_id, _text, _edited, _other``.
    """
    source = keyed(docs, id_col, text_col).select("_id", "_text")
    # the first row of each id is the one without a row before it; both sides share one shuffle of the texts by id
    before = F.lag("_id").over(W.partitionBy("_id").orderBy("_text"))
    others = source.withColumn("_b", before).where("_b IS NULL").select(F.col("_id").alias("_next"), F.col("_text").alias("_other"))
    n, cut = F.length("_text"), F.floor(F.length("_text") / 3).cast("int")
    joined = source.join(following(source), "_id").select("_id", "_text", "_next").join(others, "_next")
    return joined.select("_id", "_text", F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("_other"), F.lit(1), cut)).alias("_edited"), "_other")
