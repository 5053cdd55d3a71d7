"""Makes the package importable in Python workers, wherever the driver was started from."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kbspark-')}/kbspark", "zip", root, "kbspark")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
