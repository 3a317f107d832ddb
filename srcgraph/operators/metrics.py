"""Measures of files and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog


def analyze(facts: DataFrame) -> DataFrame:
    """path, lines, bytes, nodes, max_nesting, kinds: per kind of the language count, avg_lines, max_lines, those with none included."""
    # a map literal of the catalogue's kinds: a closed table of a few dozen names
    kinds = F.create_map(*[x for n in catalog.names() for x in (F.lit(n), F.array(*map(F.lit, sorted(catalog.get(n).symbols))))])
    spans = lambda k: F.transform(F.filter("symbols", lambda s: s["kind"] == k), lambda s: s["end"]["row"] - s["start"]["row"] + 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    one = lambda k: F.struct(
        F.size(spans(k)).alias("count"),
        F.when(F.size(spans(k)) > 0, total(spans(k)) / F.size(spans(k))).otherwise(0.0).alias("avg_lines"),
        F.coalesce(F.array_max(spans(k)), F.lit(0)).alias("max_lines"),
    )
    by_kind = F.map_from_entries(F.transform(kinds[F.col("language")], lambda k: F.struct(k, one(k))))
    return facts.where("symbols is not null").select("path", "lines", "bytes", "nodes", "max_nesting", by_kind.alias("kinds"))


def complexity(facts: DataFrame) -> DataFrame:
    """path, name, kind, complexity, start, end of every function: 1 and the branching nodes within, nested functions' too."""
    rows = facts.where("functions is not null and decisions is not null").select("path", F.explode("functions").alias("f"))
    return rows.select("path", "f.name", "f.kind", "f.complexity", "f.start", "f.end")
