"""Text by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_offset


def get_text(files: DataFrame, start_row: int, start_col: int, end_row: int, end_col: int) -> DataFrame:
    """path, text, error: the text between two positions (rows and byte columns from 0, the end exclusive); no parsing.

    A column runs on into later lines and a row past the end is the end, so bytes decide which position
    is the later one. A file in which the end precedes the start has an error and no text. Negative
    positions are an error at once.
    """
    if min(start_row, start_col, end_row, end_col) < 0:
        raise ValueError("positions must not be negative")
    ranges = files.select("path", "content", F.lit(start_row).alias("a"), F.lit(start_col).alias("b"), F.lit(end_row).alias("c"), F.lit(end_col).alias("d"))
    start, end = byte_offset(F.col("content"), F.col("a"), F.col("b")), byte_offset(F.col("content"), F.col("c"), F.col("d"))
    at = ranges.select("path", "content", start.alias("start"), end.alias("stop"))
    part = F.col("content").substr(F.col("start") + 1, F.greatest(F.lit(0), F.col("stop") - F.col("start")))
    late = F.col("stop") < F.col("start")
    error = F.when(late, F.lit(f"end position ({end_row},{end_col}) precedes start ({start_row},{start_col})"))
    return at.select("path", F.when(~late, F.make_valid_utf8(part.cast("string"))).alias("text"), error.alias("error"))
