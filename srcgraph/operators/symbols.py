"""Symbols: listing, scanning, variables, search by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_key


def symbols(facts: DataFrame, include_text: bool = False) -> DataFrame:
    """path, language, kind, ord, name, text, start, end: one row a symbol. include_text: the whole text instead of its first line."""
    s = facts.select("path", "language", F.explode("symbols").alias("s"))
    text = F.coalesce("s.full_text", "s.text") if include_text else F.col("s.text")
    return s.select("path", "language", "s.kind", "s.ord", "s.name", text.alias("text"), "s.start", "s.end")


def scan_symbols(facts: DataFrame) -> DataFrame:
    """path, kinds: a map from kind to the file's symbols of it. Row by row."""
    kinds = F.array_distinct(F.transform("symbols", lambda s: s["kind"]))
    listed = F.transform(kinds, lambda k: F.struct(k.alias("key"), F.transform(F.filter("symbols", lambda s: s["kind"] == k), lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))).alias("value")))
    return facts.where("symbols is not null").select("path", F.map_from_entries(listed).alias("kinds"))


def scan_variables(facts: DataFrame) -> DataFrame:
    """path, name, text, start, end of variables; files without any have no rows."""
    return symbols(facts).where("kind = 'variables'").select("path", "name", "text", "start", "end")


def errors(facts: DataFrame) -> DataFrame:
    """path, message of files that could not be read or parsed."""
    return facts.where("error is not null").select("path", F.col("error").alias("message"))


def search_name(facts: DataFrame, name: str, limit: int = 0) -> DataFrame:
    """file, kind, name, line (from 1), col (from 0), text of the symbols of a name, in walk order; at most `limit` if above 0.

    The name is looked for in each file's array before anything is exploded.
    """
    hits = facts.select("path", F.explode(F.filter("symbols", lambda s: s["name"] == name)).alias("s"))
    if limit > 0:
        hits = hits.orderBy(path_key(F.col("path")), "s.start", "s.kind", "s.ord").limit(limit)
    return hits.select(F.col("path").alias("file"), "s.kind", "s.name", (F.col("s.start.row") + 1).alias("line"), F.col("s.start.col").alias("col"), "s.text")
