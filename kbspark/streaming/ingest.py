"""Incremental ingest of document versions from a file stream."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from kbspark import fixed_values as fv
from kbspark.operators import ingest
from kbspark.operators.limits import broadcast_if, pin

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Bytes of a broadcast id and version, with the hash-table entry.
_VERSION_BYTES = 64


def keep_first(batch: DataFrame, batch_id: int, keys: list[str], out: str) -> None:
    """Write the changes of one micro-batch whose keys no earlier batch has, each once.

    Keys alone decide, so a first event counts however late it comes, and no state is ever dropped. The folder is named
    by the batch and overwritten: a batch that is run again looks at the same earlier ones and leaves the same result.
    """
    once = batch.dropDuplicates(keys)
    if batch_id:
        known = (batch.sparkSession.read.schema(batch.select(*keys).schema.add("batch_id", "integer")).parquet(out)
                 .filter(F.col("batch_id") < batch_id).select(*keys))
        once = once.join(known, keys, "left_anti")
    once.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def start_changes(changes: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep every change that has arrived once, then stop; ``out`` is a table of the changes by ``batch_id``."""
    return (changes.writeStream.foreachBatch(lambda batch, n: keep_first(batch, n, keys, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_keyed_changes(changes: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """The same with the keys in RocksDB, beside the tasks: a batch reads its own rows and looks its keys up.

    No key is ever dropped, so no change comes too late. State and rows of a batch are committed by its number: a batch
    that is run again finds the state before it and overwrites its own folder.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    conf, before = changes.sparkSession.conf, changes.sparkSession.conf.get(_STATE_STORE)
    conf.set(_STATE_STORE, _ROCKS_DB)
    try:
        return (changes.dropDuplicates(keys).writeStream.foreachBatch(put)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(_STATE_STORE, before)


def chunk_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Write one micro-batch: the newest version of each document, and its chunks.

    The target folder is named by the batch and overwritten, so a batch that is run again after a failure leaves the
    same result.
    """
    # Narrow rows pick the newest versions; texts meet them without a window, and the version is carried along.
    newest = pin(ingest.latest(batch.select("id", "version", "space_id"), "id", "version"), "newest-versions")
    newest.write.mode("overwrite").parquet(f"{out}/versions/batch_id={batch_id}")
    side = broadcast_if(newest.select("id", "version"), newest.count(), _VERSION_BYTES)
    texts = batch.join(side, ["id", "version"], "left_semi")
    if not batch.groupBy("id", "version").count().filter("count > 1").isEmpty():  # a version that was sent twice
        texts = texts.dropDuplicates(["id", "version"])
    made = ingest.chunk_documents(texts, keep=["version"])
    if batch_id:  # ids of earlier versions stay theirs, so that stored vectors never match a newer text
        earlier = batch.sparkSession.read.schema("id long, document_id long, batch_id int").parquet(f"{out}/chunks")
        tops = earlier.filter(F.col("batch_id") < batch_id).join(
            side.select(F.col("id").alias("document_id")), "document_id").groupBy("document_id").agg(
            (F.max("id") + 1).alias("free_id"))
        made = made.join(broadcast_if(tops, newest.count(), _VERSION_BYTES), "document_id", "left").withColumn(
            "id", F.coalesce(F.col("free_id") + F.col("chunk_index"), "id")).drop("free_id")
    made.write.mode("overwrite").parquet(f"{out}/chunks/batch_id={batch_id}")


def start_ingest(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk all document versions ``(id, space_id, content, version)`` that have arrived, then stop."""
    return (documents.writeStream.foreachBatch(lambda batch, n: chunk_batch(batch, n, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_documents(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of each document's newest version over all batches."""
    versions = spark.read.parquet(f"{out}/versions")
    newest = ingest.latest(versions, "id", "version", "batch_id").select(
        F.col("id").alias("document_id"), "version", "batch_id")
    chunks = spark.read.parquet(f"{out}/chunks").filter(F.col("status") == fv.ACTIVE)
    return chunks.join(newest, ["document_id", "version", "batch_id"], "left_semi")
