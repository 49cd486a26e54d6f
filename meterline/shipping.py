"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of one batch between Spark and a Python worker, where the session does not say: rows can be very long.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once a Spark application, and bounds batches by bytes.

    Functions that run in workers are pickled by name, so workers must import the package; a cluster where it is
    not installed gets it from the driver this way.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if here.endswith(".zip/meterline"):  # runs from a shipped archive itself
        return
    folder = tempfile.mkdtemp(prefix="meterline-package-")
    copy = os.path.join(folder, "package", "meterline")
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "meterline_package"), "zip", os.path.dirname(copy)))
