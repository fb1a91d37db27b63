"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch where the session names no bound; one row more may come with it.
BATCH_BYTES = 16 << 20
# Spark's ways to say that there is no bound.
_UNBOUNDED = (None, "-1", "2147483647", "9223372036854775807")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, as rows that hold packed blocks are large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in _UNBOUNDED:
        spark.conf.set(name, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    archive = os.path.join(folder, "shapescreen.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
