"""Exact dedup: groups by a 128-bit hash of the normalised text, with the texts of a group compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, id_back, saved
from weftline.llm.lookup import looked_up

#: White space that counts as one space each run.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null: empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def hashed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(_id, _h, _text): ids that are never null, 128-bit hashes and normalised texts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    return rows.select("_id", F.unhex(digest(F.col("_text"))).alias("_h"), "_text")


def members(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(_id, _h, _sha, _keep, _size) of each row: what it is, the least id of its group and the group's rows.

    Groups are formed by hash and text, so that Spark compares the bytes of texts with equal hashes; copies are counted before the
    shuffle. Rows then find their group by its hash alone, but for hashes that several texts share: those rows find it by
    hash and text.
    """
    rows = hashed(docs, id_col, text_col, digest)
    groups = rows.groupBy("_h", "_text").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    hashes = saved(groups.groupBy("_h").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.count("*").alias("_texts")))
    facts = hashes.agg(F.sum("_size"), F.max("_texts")).first()
    total, clash = facts[0] or 0, (facts[1] or 0) > 1
    # the weight is left out of a lookup's result, the size is wanted
    found = hashes.where("_texts = 1").select("_h", "_keep", "_size", F.col("_size").alias("_weight"))
    slim = rows.select("_id", "_h", F.sha2("_text", 256).alias("_sha"), "_text" if clash else F.lit(None).cast("string").alias("_text"))
    if not clash:
        return looked_up(slim.drop("_text"), found, ["_h"], "_weight", total)
    shared = hashes.where("_texts > 1").select("_h", F.lit(True).alias("_clash"), F.col("_size").alias("_weight"))
    told = looked_up(slim, shared, ["_h"], "_weight", total)
    plain = looked_up(told.where("_clash IS NULL").drop("_text", "_clash"), found, ["_h"], "_weight", total)
    exact = groups.join(hashes.where("_texts > 1").select("_h"), "_h", "left_semi").withColumn("_weight", F.col("_size"))
    return plain.unionByName(looked_up(told.where("_clash").drop("_clash"), exact, ["_h", "_text"], "_weight", total).drop("_text"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row: texts are equal that differ in runs of white space alone.

    The row of the least id of a group is kept. Null texts are empty; a null id is less than any other, and as ``keep_id`` null;
    rows with equal ids and texts are one document, so that all of them are kept or none, and each counts in ``group_size``; an
    empty table gives no rows. ``digest`` is a column's hash as hexadecimal digits; results don't depend on it, as texts are compared.
    """
    rows = members(docs, id_col, text_col, digest)
    return rows.select(id_back().alias("doc_id"), id_back("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_id") == F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps."""
    kept = members(docs, id_col, text_col, F.md5).where("_id = _keep").select("_id", "_sha").distinct()
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    keys = docs.withColumns({"__id": ids, "__sha": F.sha2(normalised(F.col(text_col)), 256)})
    return keys.join(kept.select(F.col("_id").alias("__id"), F.col("_sha").alias("__sha")), ["__id", "__sha"], "left_semi").select(*docs.columns)
