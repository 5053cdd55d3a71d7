"""Running per-document task counts from a stream of chunk outcomes."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kbspark.operators import ingest
from kbspark.operators.vectorize import finished

# Batches between two snapshots.
COMPACT_EVERY = 20


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Task counts per document of ``(document_id, outcome)``; the same for a stream and for a table."""
    def those(name: str):
        return F.count_if(F.col("outcome") == name)

    success, failed, skipped = those("success"), those("failed"), those("skipped")
    return outcomes.groupBy("document_id").agg(
        F.count("*").alias("total_chunk_count"), (success + failed).alias("pending_chunk_count"),
        success.alias("success_count"), failed.alias("failed_count"), skipped.alias("skipped_count"))


def start_rollup(outcomes: DataFrame, out: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Write the changed counts of every micro-batch; a repeated batch overwrites its own folder.

    The state is five counters per document. It is kept in RocksDB where the session asks for it. After every
    ``compact_every`` batches their newest rows are merged with the snapshot before into a new one.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, out, batch_id)

    return (outcome_counts(outcomes).writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _folders(spark: SparkSession, pattern: str) -> dict[int, str]:
    """Folders that match, by the number that their names end in; only finished ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = [one.getPath().getParent() for one in files.globStatus(done) or []]
    return {int(folder.getName().rsplit("=", 1)[-1]): folder.toString() for folder in found}


def _parts(spark: SparkSession, out: str) -> tuple[int, list[str], list[str]]:
    """The last batch in the newest snapshot (-1: none), the snapshot, and the folders of later batches."""
    snapshots, batches = _folders(spark, f"{out}/_snapshots/upto=*"), _folders(spark, f"{out}/batch_id=*")
    last = max(snapshots, default=-1)
    return last, [snapshots[last]] if snapshots else [], [folder for n, folder in sorted(batches.items()) if n > last]


def _newest(spark: SparkSession, snapshot: list[str], batches: list[str], out: str) -> DataFrame:
    """The newest row of each document, with the ``batch_id`` it came in."""
    parts = [spark.read.parquet(*snapshot)] if snapshot else []
    if batches:
        parts.append(spark.read.option("basePath", out).parquet(*batches).withColumn("batch_id", F.col("batch_id").cast("long")))
    rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    return ingest.latest(rows, "document_id", "batch_id")


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Merge everything up to a batch into a snapshot; batches in the snapshot before it are removed.

    A snapshot counts once it is complete. It is a function of its batches, so writing it again changes nothing; readers
    of the snapshot before still find the batches after that one.
    """
    last, snapshot, batches = _parts(spark, out)
    if last >= upto:
        return
    wanted = [folder for folder in batches if int(folder.rsplit("=", 1)[-1]) <= upto]
    _newest(spark, snapshot, wanted, out).write.mode("overwrite").parquet(f"{out}/_snapshots/upto={upto}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(out).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [folder for n, folder in _folders(spark, f"{out}/batch_id=*").items() if n <= last]
    old += [folder for n, folder in _folders(spark, f"{out}/_snapshots/upto=*").items() if n < last]
    for folder in old:
        files.delete(hadoop(folder), True)


def current_tasks(spark: SparkSession, out: str) -> DataFrame:
    """The latest counts of every document, with its task status and message; reads one snapshot and the batches since."""
    _, snapshot, batches = _parts(spark, out)
    return finished(_newest(spark, snapshot, batches, out).drop("batch_id"))
