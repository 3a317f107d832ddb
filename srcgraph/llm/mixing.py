"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a target number of words: its weight's part of a share of all words, at most
CAP times what the source has, the excess going to the others by weight. The target is met by
complete epochs of the source and then by a weighted sample without replacement: every document
draws an exponential key, -ln(u) / quality weight (Efraimidis and Spirakis), and documents are
taken by ascending key until the words are reached; the document at the border is taken in part.

A running sum over a source would put the source into one task. Keys are therefore cut into cells,
CELLS for each factor of e, and cells into as many ranges as the source's rows ask for. Whatever
the weights, a cell holds at most 1 / (e CELLS) of a source's rows on average, as that is the most
that an exponential distribution, and so any mixture of them, puts there. Ranges are summed before
they are shuffled, the sums are added up within cells and over the cells of a source, and only a
range's own rows are sorted together.

Defined results: a null text has size 0; null sources are one source, the last; documents without
words are taken with 0 words; rows that repeat a document id are drawn one by one, equal rows in
arbitrary but equivalent order; a null or non-positive quality weight counts as 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources by name, the share of all words to take, and the most often a source is taken.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Rows of a key range that are sorted together, cells of keys for each factor of e, and parts of a source's rows in joins.
BUCKET_ROWS, CELLS, SALTS = 10_000, 64, 64


def uniform(id_col: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs -> with target.

    The targets are min(CAP * size, level * weight) with one level for all sources: sources are put
    in order of the level that fills them, and the level is found from running sums. One row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, everything, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1)), by_fill.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("place", F.row_number().over(by_fill)).withColumn("level", (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source in this order that its level does not fill gives the level of all
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"])
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "n_docs", "target")


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs, and text_hash, a 64-bit hash of its text.

    quality: (doc_id, weight), one or more rows a document (their mean counts); else all weigh 1.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    if quality is not None:
        mean = quality.groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        rows = rows.join(mean, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    rows = settled(rows.select("doc_id", "source", "size", "text_hash", (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key")), "mix-rows")

    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    goal = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    at = salted.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source and r.salt = g.salt")).select("r.doc_id", "r.source", "r.size", "r.text_hash", "r.key", "g.source_size", "g.target", "g.n_docs")
    cell = F.floor(F.log("key") * CELLS)
    ranges = F.ceil(F.col("n_docs") / (math.e * CELLS * BUCKET_ROWS))
    low = F.exp(F.col("cell") / CELLS)
    part = F.floor((F.col("key") / low - 1) / (math.exp(1 / CELLS) - 1) * ranges)
    at = at.withColumn("cell", cell).withColumn("part", F.greatest(F.lit(0), F.least(part, ranges - 1))).drop("n_docs")

    running = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda words, window: F.coalesce(F.sum(words).over(window), F.lit(0))
    parts = at.groupBy("source", "cell", "part").agg(F.sum("size").alias("words"))
    cells = parts.groupBy("source", "cell").agg(F.sum("words").alias("words"))
    cells = cells.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), before("words", running("source", "cell")).alias("of_cells"))
    parts = parts.withColumn("of_parts", before("words", running("source", "cell", "part"))).join(cells, F.expr("source <=> c_source and cell = c_cell"))
    sums = parts.select(F.col("source").alias("b_source"), F.col("cell").alias("b_cell"), F.col("part").alias("b_part"), (F.col("of_cells") + F.col("of_parts")).alias("ahead"))
    within = Window.partitionBy("source", "cell", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("before", before("size", within))
    at = at.join(sums, F.expr("source <=> b_source and cell = b_cell and part = b_part"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    sampled = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("ahead") - F.col("before")))
    return at.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + sampled).cast("long").alias("taken"), "text_hash")


def mix_copies(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) with each row as often as the mix takes it, parts of a document rounded.

    Rows that repeat id, source and text stand equally often.
    """
    columns = docs.columns
    taken = mix_sources(docs, quality, seed)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = taken.groupBy("doc_id", "source", "text_hash").agg(F.round(F.avg(copies)).cast("int").alias("copies")).where("copies > 0")
    joined = docs.withColumn("_h", F.xxhash64(docs["text"].cast("string"))).alias("d").join(each.alias("e"), F.expr("d._h = e.text_hash and d.doc_id <=> e.doc_id and cast(d.source as string) <=> e.source"))
    return joined.select(*(F.col(f"d.`{c}`") for c in columns), F.explode(F.sequence(F.lit(1), F.col("e.copies"))).alias("_copy")).select(*(F.col(f"`{c}`") for c in columns))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels (doc_id, quality): good documents 2, others 0.5; unlabelled ones get 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
