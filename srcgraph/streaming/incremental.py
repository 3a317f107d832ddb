"""Facts of files as they arrive: the parsing pass is row by row, so it runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.facts import FILES, facts


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet tables of files(path, language, content) that land in a folder."""
    return spark.readStream.schema(FILES).parquet(folder)


def write_facts(files: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each new file's facts to a Parquet table; exactly once, by the file sink and its checkpoint."""
    return facts(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
