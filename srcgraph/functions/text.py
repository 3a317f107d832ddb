"""Text functions: in Python for the parsing pass, and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_line(text: str) -> str:
    """The first line with white space collapsed; above 200 bytes, 197 of them and dots."""
    line = " ".join(text.partition("\n")[0].split())
    if len(line) <= 50:  # 200 bytes at most
        return line
    raw = line.encode("utf-8", "replace")
    return raw[:197].decode("utf-8", "replace") + "..." if len(raw) > 200 else line


def first_line_column(text: Column) -> Column:
    """The same as a column; a character that the cut splits becomes one U+FFFD."""
    line = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), r"(?U)\s+", " "))
    cut = F.make_valid_utf8(F.encode(line, "UTF-8").substr(F.lit(1), F.lit(197)).cast("string"))
    return F.when(F.octet_length(line) > 200, F.concat(cut, F.lit("..."))).otherwise(line)


def line_count(content: Column) -> Column:
    """Newlines and one."""
    text = content.cast("string")
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def occurrences(text: Column, part: Column) -> Column:
    """How often a part is in a text, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def byte_offset(content: Column, row: Column, column: Column) -> Column:
    """The byte at (row, column): columns run on into later lines, rows past the end give the end."""
    # byte lengths of the lines, their newlines included
    lines = F.transform(F.split(F.decode(content, "ISO-8859-1"), "\n"), lambda l: F.length(l) + 1)
    start = F.aggregate(F.slice(lines, F.lit(1), F.least(row, F.size(lines))), F.lit(0), lambda a, n: a + n)
    size = F.octet_length(content)
    return F.when(row >= F.size(lines), size).otherwise(F.least(size, start + column))


def path_key(path: Column) -> Column:
    """Sorts paths as a walk visits them: by components."""
    return F.split(path, "/")
