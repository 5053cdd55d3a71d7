"""Size checks that decide whether a side may be broadcast.

Every operator that broadcasts measures the side first. Beyond the bound each of them has an exact way that does
not broadcast more than the bound at a time.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kbspark.sources.folders import shared_folder

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_BROADCAST_ROWS = 2_000_000

# Spark pushes a ``row_number() <= n`` below the shuffle only for n up to this default threshold.
GROUP_LIMIT_MAX = 1000


def max_broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("kbspark.maxBroadcastBytes", str(MAX_BROADCAST_BYTES)))


def broadcast_if(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when at most ``rows`` rows of ``row_bytes`` bytes fit the bound.

    ``rows`` must be an upper bound that was measured or follows from one; without the hint Spark picks a shuffle
    join (with runtime skew splitting) on its own statistics.
    """
    fits = rows <= MAX_BROADCAST_ROWS and rows * row_bytes <= max_broadcast_bytes(df.sparkSession)
    return F.broadcast(df) if fits else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split a scan of fewer partitions than cores; a large scan is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def pin(rows: DataFrame, name: str) -> DataFrame:
    """A request or result table that feeds several branches of a job, computed once.

    It is written to the shared checkpoint folder and read back, which survives the loss of any executor; Spark then
    sees its true size. Nothing passes through the driver.
    """
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def in_slices(parts: list[Callable[[], DataFrame]], schema: StructType, spark: SparkSession, name: str) -> DataFrame:
    """All rows of ``parts``, which are computed one after the other so that their broadcasts are not alive together."""
    folder = shared_folder(spark, name)
    for part in parts:
        part().write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if parts else spark.createDataFrame([], schema)
