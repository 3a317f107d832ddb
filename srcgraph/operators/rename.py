"""What a rename would touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_key


def rename_preview(facts: DataFrame, name: str, limit: int = 0, per_file: bool = False) -> DataFrame:
    """file, line, col, text (the parent's first line), definition: identifiers of a name in walk order.

    limit: at most so many rows. per_file: files after the limit still give their first row each, as
    a scan does that only leaves the file it is in.
    """
    rows = facts.select("path", F.filter("identifiers", lambda i: i["text"] == name).alias("hits"), F.transform(F.filter("symbols", lambda s: s["has_name"] & (s["name"] == name)), lambda s: s["name_start"]).alias("defined"))
    hits = rows.where(F.size("hits") > 0).select("path", "defined", F.explode("hits").alias("h"))
    if limit > 0 and per_file:
        # only the first rows of a file can count: numbers within it first, then over all files
        hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("h.ord"))).where(F.col("nth") <= limit)
        firsts = hits.where("nth = 1")
        top = hits.orderBy(path_key(F.col("path")), "h.ord").limit(limit)
        late = firsts.join(top.select("path").distinct(), "path", "left_anti")
        hits = top.unionByName(late)
    elif limit > 0:
        hits = hits.orderBy(path_key(F.col("path")), "h.ord").limit(limit)
    return hits.select(F.col("path").alias("file"), (F.col("h.start.row") + 1).alias("line"), F.col("h.start.col").alias("col"), F.col("h.parent_text").alias("text"), F.coalesce(F.array_contains("defined", F.col("h.start")), F.lit(False)).alias("definition"))
