"""The shared folder for checkpoints and written intermediate tables."""

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"

_local = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for ``purpose`` under the folder the session names in ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run on this machine, as in local tests, a temporary folder is used; on a
    cluster the executors would each write to a disk of their own.
    """
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = tempfile.mkdtemp(prefix="kbspark-")
        base = _local[application]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of a write's shuffles go as soon as it is done; else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
