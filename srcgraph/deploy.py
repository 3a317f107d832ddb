"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors of a session, once; workers import them from there."""
    context = spark.sparkContext
    if getattr(context, "_srcgraph_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="srcgraph-")) / "srcgraph.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_HERE.rglob("*.py")):
            z.write(f, f.relative_to(_HERE.parent))
    context.addPyFile(str(target))
    context._srcgraph_shipped = True
