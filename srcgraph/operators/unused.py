"""Names that occur once.

A declared name is unused if it occurs once in all scanned files, as text: `Foo` within `FooBar`
counts. Comparing every name with every file would be a cross join. Instead the files' runs are
counted, maximal runs of identifier characters and of other visible ones; a run that is a name counts
for it, and two such hits rule the name out. For the names left, the pieces of longer runs that have
a name's length are looked up by hash, an equi-join. Names of several runs are counted in the files
that hold one of their runs, the rarest; a run at a name's edge may be the end of a longer one.

A long run is taken in stretches of STRETCH characters, so no row holds all pieces of one.

Names, runs and texts grow with the corpus, so they meet by sort and merge: a table of names that is
small as it is shuffled, compressed, would fill the driver as a broadcast. Only sets of lengths are sent to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, path_key

_WORD = r"A-Za-z0-9_$\x{80}-\x{10FFFF}"
_RUN = rf"[{_WORD}]+|[^{_WORD}\s]+"
#: Characters of a run whose pieces are made together.
STRETCH = 256


def declarations(facts: DataFrame) -> DataFrame:
    """The first declaration of each name but imports: by walk order, start, kind."""
    s = facts.select("path", F.explode("symbols").alias("s")).where("s.kind <> 'imports' and s.name <> ''")
    first = F.min_by(F.struct("path", "s.kind", "s.start", "s.text", "s.name"), F.struct(path_key(F.col("path")), F.col("s.start"), F.col("s.kind"), F.col("s.ord")))
    return s.groupBy(F.col("s.name").alias("name")).agg(first.alias("d"))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_RUN})"))


def _pieces(runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """run, n, name: the pieces of runs(run, n) that are shorter than their run and of a length in the one row of lengths."""
    longer = runs.crossJoin(F.broadcast(lengths)).where(F.exists("lengths", lambda l: l < F.length("run")))  # one row: the set of lengths
    stretches = longer.withColumn("s", F.explode(F.sequence(F.lit(1), F.length("run"), F.lit(STRETCH))))
    starts = F.sequence(F.col("s"), F.least(F.length("run"), F.col("s") + STRETCH - 1))
    fits = F.filter("lengths", lambda l: (l < F.length("run")) & (F.col("s") + l - 1 <= F.length("run")))
    pieces = F.flatten(F.transform(fits, lambda l: F.transform(F.filter(starts, lambda i: i + l - 1 <= F.length("run")), lambda i: F.substring("run", i, l))))
    return stretches.select("run", "n", F.explode(F.array_distinct(pieces)).alias("name"))


def unused_symbols(facts: DataFrame, files: DataFrame, limit: int = 0) -> DataFrame:
    """file, kind, name, line, col, text of names that occur once in files(path, content), in walk order."""
    # asked several times: conditions on the chosen rows, not on the grouping key, leave the shuffle
    # below the same for all, so it runs once and the files are parsed once
    declared = declarations(facts)
    text = files.where("content is not null").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    counts = text.select(F.explode(_runs(F.col("content"))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))

    plain = declared.where(F.col("d.name").rlike(f"^(?:{_RUN})$"))
    exact = plain.join(counts.hint("merge"), F.col("name") == F.col("run"), "left").select("name", "d", F.coalesce("n", F.lit(0)).alias("n")).where("n <= 1")
    pieces = _pieces(counts, exact.agg(F.collect_set(F.length("name")).alias("lengths")))
    # most pieces are no names: hashes sort that out, and only names that are within runs meet their runs again
    inner = exact.select("name", F.xxhash64("name").alias("h")).join(pieces.select(F.xxhash64("name").alias("h")).hint("merge"), "h", "left_semi").select("name")
    within = pieces.join(inner.hint("merge"), "name").distinct().groupBy("name").agg(F.sum(F.col("n") * occurrences(F.col("run"), F.col("name"))).alias("more"))
    once = exact.join(within.hint("merge"), "name", "left").where("n + coalesce(more, 0) = 1").select("name", "d")

    # names of several runs: each run of a name with the number of runs like it; the rarest one leads to the files
    other = declared.where(~F.col("d.name").rlike(f"^(?:{_RUN})$"))
    named = other.select("name", F.explode(F.array_distinct(_runs(F.col("name")))).alias("run"))
    rare = named.join(counts.hint("merge"), "run", "left").groupBy("name").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), F.col("run"))).alias("anchor"))
    held = text.select("path", F.explode(F.array_distinct(_runs(F.col("content")))).alias("run"))
    whole = rare.join(held.hint("merge"), F.col("run") == F.col("anchor")).select("name", "path")
    # the beginnings and ends of longer runs
    sizes = rare.agg(F.coalesce(F.collect_set(F.length("anchor")), F.array().cast("array<int>")).alias("lengths"))
    edge = F.flatten(F.transform(F.filter("lengths", lambda l: l < F.length("run")), lambda l: F.array(F.substring("run", F.lit(1), l), F.substring("run", F.length("run") - l + 1, l))))
    ends = held.crossJoin(F.broadcast(sizes)).select("path", F.explode(F.array_distinct(edge)).alias("anchor"))
    partial = rare.join(ends.hint("merge"), "anchor").select("name", "path")
    places = whole.unionByName(partial).distinct()
    counted = places.join(text.hint("merge"), "path").groupBy("name").agg(F.sum(occurrences(F.col("content"), F.col("name"))).alias("n"))
    odd = other.join(counted.hint("merge"), "name").where("n = 1").select("name", "d")

    found = once.unionByName(odd)
    if limit > 0:
        found = found.orderBy(path_key(F.col("d.path")), "d.start", "name").limit(limit)
    return found.select(F.col("d.path").alias("file"), F.col("d.kind").alias("kind"), "name", (F.col("d.start.row") + 1).alias("line"), F.col("d.start.col").alias("col"), F.col("d.text").alias("text"))
