"""Calls: each function's callees, and the callers of a name.

The parsing pass gives every call its function, the innermost around it, so these are questions to
one array of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_key


def call_graph(facts: DataFrame) -> DataFrame:
    """path, name, kind, callees (name and count, in order of the first call), start, end for every function. Row by row."""
    rows = facts.where("functions is not null and calls is not null").select("path", F.explode("functions").alias("f"))
    callees = F.transform("f.callees", lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count")))
    return rows.select("path", "f.name", "f.kind", callees.alias("callees"), "f.start", "f.end", "f.place")


def callers(facts: DataFrame, name: str, limit: int = 0) -> DataFrame:
    """file, name, kind, line, col, count: functions that call a name.

    Same-named functions of a file are one row, with the attributes of the one that calls first.
    """
    hit = lambda f: F.get(F.filter(f["callees"], lambda c: c["name"] == name), F.lit(0))
    seen = F.transform("functions", lambda f: F.struct(hit(f)["first"].alias("first"), hit(f)["count"].alias("count"), f["name"].alias("name"), f["kind"].alias("kind"), f["start"].alias("start")))
    rows = facts.where("functions is not null and calls is not null").select("path", F.array_sort(F.filter(seen, lambda f: f["count"].isNotNull())).alias("hits")).where(F.size("hits") > 0)
    mine = lambda n: F.filter("hits", lambda f: f["name"] == n)
    merged = F.transform(F.array_distinct(F.transform("hits", lambda f: f["name"])), lambda n: F.struct(mine(n)[0].alias("f"), F.aggregate(mine(n), F.lit(0), lambda t, f: t + f["count"]).alias("count")))
    out = rows.select("path", F.explode(merged).alias("m"))
    if limit > 0:
        out = out.orderBy(path_key(F.col("path")), "m.f.first").limit(limit)
    return out.select(F.col("path").alias("file"), F.col("m.f.name").alias("name"), F.col("m.f.kind").alias("kind"), (F.col("m.f.start.row") + 1).alias("line"), F.col("m.f.start.col").alias("col"), F.col("m.count").alias("count"))


def no_call_query(language: str) -> ValueError:
    return ValueError(f"language {language} has no call query")
