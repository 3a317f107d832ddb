"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters per slice that one numpy pass works on; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session (tests) may do without: it gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="srcgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; clear() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: By application, the paths that its work has made.
_paths: dict[str, list[str]] = {}


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and no executor is needed to keep it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled = path
    return table


def _delete(path: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        store.delete_dir(root)


def discard(table: DataFrame) -> None:
    """Delete a settled table that nothing reads any more: what was made from it is settled itself."""
    paths = _paths[table.sparkSession.sparkContext.applicationId]
    paths.remove(table._settled)
    _delete(table._settled)


def clear(spark: SparkSession) -> None:
    """Delete all tables, archives and indexes that this application's operators have made; results that read them are void."""
    for path in _paths.pop(spark.sparkContext.applicationId, []):
        _delete(path)


def partitions(df: DataFrame) -> int:
    """Partitions for an explicit shuffle of what df's texts make: the session's number, more if df itself has more."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


#: Rows of an Arrow batch: rows are whole texts, and Spark's usual 10,000 of them would fill an executor's memory beside its heap.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df; its session hands texts to Python in batches of BATCH_ROWS, unless it was told another number than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def sliced(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) for runs of rows with about `limit` bytes; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def per_text(fn: Callable[[str], tuple], names: list[str], types: list[pa.DataType], text: int = -1) -> Callable:
    """For mapInArrow: the columns but the text, then what fn makes of each row's text (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = text % batch.num_columns
            rest = [i for i in range(batch.num_columns) if i != at]
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = [fn(t or "") for t in part.column(at).to_pylist()]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in rest] + columns, names=[batch.schema.names[i] for i in rest] + names)

    return run


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined with a smaller right that has one row a key; a key's left rows are dealt over `salts` tasks. Null keys don't meet."""
    from pyspark.sql import functions as F

    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Edges that a task unites at once.
CHUNK = 200_000


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over some (u, v) at a time: u, v being a node and the least of its component, for nodes that are not it."""
    root: dict = {}
    kind, seen = None, 0

    def top(x: object) -> object:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def flush() -> Iterator[pa.RecordBatch]:
        found = [(x, r) for x in root if (r := top(x)) != x]
        for s in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found[s : s + 10_000], strict=True)], names=["u", "v"])

    for batch in batches:
        kind, seen = batch.schema.field(0).type, seen + batch.num_rows
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = top(u), top(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if seen >= 2 * CHUNK:  # parts of a table are not of one size
            yield from flush()
            root, seen = {}, 0
    yield from flush()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): node, root (the least of the component), for nodes of edges between two.

    In each round tasks unite the edges, CHUNK at once, in as few tasks as that takes. If it takes
    several, large-star and small-star steps follow, until every node has one edge, to a node that has
    none. Each round is a table in the shared folder; the driver only learns its size and whether it is the last.
    """
    from pyspark.sql import functions as F

    now = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    kind = now.schema["u"].dataType.simpleString()
    now = settled(now, "edges")
    while True:
        tasks = -(-now.count() // CHUNK) or 1
        forests = now.coalesce(tasks).mapInArrow(_forests, f"u {kind}, v {kind}")
        before, now = now, settled(forests if tasks == 1 else forests.distinct(), "edges")
        discard(before)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if tasks == 1 or ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # only nodes with larger neighbours pass their least one on, and only those with several need it joined
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("most > u").select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1").select("u", "m")
        small = spread_join(large, least, ["u"], "left").withColumn("m", F.coalesce("m", "v"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, settled(small, "edges")
        discard(before)
