"""Files from directories, single files and tables.

The walk visits entries in lexical order, skips hidden directories (not a hidden root) and keeps
hidden files and names that begin with an underscore, which Spark's own file sources leave out. A
folder that is not there has no files. Contents are read by the executors.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import catalog
from ..plans.facts import FILES


def walk(root: str, language: str | None = None) -> Iterator[tuple[str, str]]:
    """(path, language) of the files to read: of one language by its extensions, else of all known."""
    chosen = catalog.get(language) if language else None
    if os.path.isfile(root):
        found = chosen or catalog.detect(root)
        if found:
            yield root, found.name
        return
    stack = [root]
    while stack:
        at = stack.pop()
        if os.path.isdir(at) and not os.path.islink(at) or at == root:
            try:
                inside = sorted(os.listdir(at), reverse=True)
            except OSError:
                continue
            for name in inside:
                full = os.path.join(at, name)
                if not (name.startswith(".") and os.path.isdir(full)):
                    stack.append(full)
        elif chosen:
            if at.endswith(chosen.extensions):
                yield at, chosen.name
        elif found := catalog.detect(at):
            yield at, found.name


class _Paths(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        super().__init__(len(rows))
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.language = options.get("path") or options.get("root") or ".", options.get("language")
        self.files_each = int(options.get("filesPerPartition", 256))

    def partitions(self) -> list[InputPartition]:
        rows = list(walk(self.root, self.language))
        return [_Paths(rows[i : i + self.files_each]) for i in range(0, len(rows), self.files_each)] or [_Paths([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for path, language in partition.rows:
            content, error = None, None
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError as e:
                error = f"reading {path}: {e.strerror or e}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([language]), pa.array([content], pa.binary()), pa.array([error], pa.string())], schema=schema)


class SourceWalk(DataSource):
    """spark.read.format("srcwalk").option("language", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "srcwalk"

    def schema(self) -> str:
        return FILES + ", error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_directory(spark: SparkSession, root: str, language: str | None = None, files_per_partition: int = 256) -> DataFrame:
    """path, language, content, error of all files below a folder."""
    if language:
        catalog.get(language)
    spark.dataSource.register(SourceWalk)
    reader = spark.read.format("srcwalk").option("root", root).option("filesPerPartition", files_per_partition)
    return (reader.option("language", language) if language else reader).load()


def read_store(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """path, language, content, error of all files below a folder of any store that Spark reads, listed and read by Spark.

    For folders that are too large for the driver to list, or not on its disk. As with Spark's other
    file sources, empty files and names that begin with a dot or an underscore are not seen; paths are URIs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return from_table(files.where(_known(F.col("path"), language)), "path", "content", language)


def _known(path: Column, language: str | None) -> Column:
    """Does a path end with an extension of the language, or of any?"""
    extensions = [e for n in ([language] if language else catalog.names()) for e in catalog.get(n).extensions]
    return functools.reduce(lambda a, b: a | b, [path.endswith(e) for e in extensions])


def read_file(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """One file as a row; unlike a scan, an unknown language or a file that can't be read is an error."""
    found = catalog.resolve(path, language)
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        raise OSError(f"reading {path}: {e.strerror or e}") from e
    return spark.createDataFrame([(path, found.name, bytearray(content), None)], FILES + ", error string")


def from_table(table: DataFrame, path: str = "path", content: str = "content", language: str | None = None) -> DataFrame:
    """Files from any table: content as text or bytes, languages by extension unless given; rows of no known language drop out."""
    extension = F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1)
    known = F.create_map(*[F.lit(x) for pair in sorted(catalog.by_extension().items()) for x in pair])
    chosen = F.lit(catalog.get(language).name) if language else known[extension]
    return table.select(F.col(path).alias("path"), chosen.alias("language"), F.col(content).cast("binary").alias("content"), F.lit(None).cast("string").alias("error")).where("language is not null")
