"""Trees and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_key
from ..plans.facts import check_query, nested, nodes, query_matches


def parse_ast(files: DataFrame, max_depth: int | None = 20, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All nodes down to a depth (20 unless given; 0 means 20, negative no limit), or some of their columns."""
    return nodes(files, 20 if max_depth in (0, None) else max_depth, columns)


def has_error(facts: DataFrame) -> DataFrame:
    """path, has_error: is anything in the tree an error or missing?"""
    return facts.where("error is null").select("path", "has_error")


def ast_json(files: DataFrame, max_depth: int = 20) -> dict[str, dict]:
    """path -> nested tree, for a few files: the result is gathered on the driver."""
    out: dict[str, list] = {}
    for row in parse_ast(files, max_depth).where("error is null").select("path", "node_id", "parent_id", "kind", "field", "named", "start", "end").toLocalIterator():
        out.setdefault(row["path"], []).append(row)
    return {path: nested(rows) for path, rows in out.items()}


def query_ast(files: DataFrame, query: str, language: str | None = None, limit: int = 0, include_text: bool = False) -> DataFrame:
    """path, match_id, captures, error of a tree pattern in walk order; an invalid query is an error at once."""
    check_query(query, language)
    found = query_matches(files, query, include_text, limit)
    return found.orderBy(path_key(F.col("path")), "match_id").limit(limit) if limit > 0 else found
