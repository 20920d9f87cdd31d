"""Readers and writers of line-delimited JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.segments import CONTROL, KINDS

BAD = "_bad_line"


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Any line that is no object of the schema ends the query with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines of the schema, and ``_bad_line`` with the text of each line that is none (its fields are null)."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", StructType([*schema.fields]).add(BAD, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return rows.select(parsed.alias("_r")).select("_r.*")


def good_lines(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, head): each line that is no JSON, with its file, length and first characters."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("file", F.octet_length("value").alias("bytes"), F.substring("value", 1, 80).alias("head"))


def append_control(rows: DataFrame, path: str, type_col: str = "type") -> None:
    """Appends control records as JSON lines; a segment among them ends the job with an error."""
    kind = F.col(type_col)
    checked = rows.withColumn(type_col, F.when(~kind.isin(*KINDS) & kind.isin(*CONTROL), kind).otherwise(F.raise_error(F.concat(F.lit("not a control record: "), F.coalesce(kind, F.lit("null"))))))
    checked.write.mode("append").json(path)


def write_long_csv(rows: DataFrame, path: str) -> None:
    """A long report as CSV with a header; quotes are doubled, nulls left empty."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
