"""Tables that are made once and asked often: a corpus's files and its facts.

Parsing is dearer than any question to its results, so facts are written as Parquet and read column
by column. A table is known by a name for as long as its application runs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="srcgraph-store-")


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a name, made and written if this application has not done so yet."""
    key = (spark.sparkContext.applicationId, name)
    if key in _paths:
        try:
            return spark.read.parquet(_paths[key])
        except AnalysisException:  # someone has cleared the folder
            pass
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    make().write.parquet(path)
    _paths[key] = path
    return spark.read.parquet(path)


def forget(spark: SparkSession, name: str) -> None:
    """Make the table of a name anew when it is asked for next, as its source has changed."""
    _paths.pop((spark.sparkContext.applicationId, name), None)
