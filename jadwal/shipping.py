"""Sends the package to the executors, so that its functions can run there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
BATCH_ROWS, USUAL = "1000", "10000"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Spark's file server reads the archive when an executor asks for it, so it stays until the driver ends. Arrow batches get fewer
    rows, unless the session has a number of its own, since rows with whole texts are large and are buffered several times.
    """
    context, batch = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch, USUAL) == USUAL:
        spark.conf.set(batch, BATCH_ROWS)
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="jadwal-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/jadwal.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/jadwal.zip")
    _sent.add(context.applicationId)
