"""Logs kept as concatenated zstd frames: whole frames are read, a truncated tail is reported, not fatal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of a frame and of a skippable frame (the low half byte of the first is free), fixed values.
FRAME, SKIPPABLE = b"\x28\xb5\x2f\xfd", b"\x2a\x4d\x18"


def frames(data: bytes) -> tuple[list[bytes], int]:
    """The contents of the whole frames and how many bytes at the end were not read."""
    import zstandard

    out, at = [], 0
    while at + 4 <= len(data):
        if data[at + 1 : at + 4] == SKIPPABLE and data[at] >> 4 == 5:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                break
            at = end
            continue
        if data[at : at + 4] != FRAME:
            break
        reader = zstandard.ZstdDecompressor().decompressobj()
        try:
            body = reader.decompress(data[at:])
        except zstandard.ZstdError:
            break
        if not reader.eof:
            break
        out.append(body)
        at = len(data) - len(reader.unused_data)
    return out, len(data) - at


def read_lines(spark: SparkSession, path: str, pattern: str = "*.zst*") -> DataFrame:
    """(file, line, text, unread): the lines of each file, by file and number; ``unread`` is the file's count of bytes left over."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                bodies, unread = frames(bytes(data))
                lines = b"".join(bodies).decode("utf-8", "replace").split("\n")
                yield pd.DataFrame({"file": name, "line": range(1, len(lines) + 1), "text": lines, "unread": unread})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(rows, "file string, line long, text string, unread long").where(F.trim("text") != "")
