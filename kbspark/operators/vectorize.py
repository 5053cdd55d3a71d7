"""Vectors for pending chunks, their outcomes, and per-document task rows."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import codes
from kbspark.operators.limits import broadcast_if, pin

# Bytes of a broadcast (chunk, outcome) row.
_OUTCOME_BYTES = 64


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("document_id"))


def is_pending(retry_failed: bool = False):
    waiting = [fv.EMBEDDING_PENDING] + ([fv.EMBEDDING_FAILED] if retry_failed else [])
    return (F.col("status") == fv.ACTIVE) & F.col("embedding_status").isin(*waiting)


def pending_chunks(chunks: DataFrame, documents: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Active chunks of active documents that wait for a vector; failed ones only on request."""
    return chunks.filter(is_pending(retry_failed)).join(active_documents(documents), "document_id", "left_semi")


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Id and metadata of each chunk's vector."""
    return chunks.select(
        codes.vector_id(F.col("id")).alias("vector_id"), F.col("id").alias("chunk_id"), "document_id", "space_id",
        "chunk_index", F.lit(fv.VECTOR_SOURCE).alias("source"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Chunks with the ``embedding`` a vector table has for them (null when it has none).

    A table that has several vectors of a chunk gives it the smallest, so no chunk is doubled.
    """
    one = vectors.groupBy(key).agg(F.min("embedding").alias("embedding"))
    return chunks.join(one, key, "left")


def _vectorised(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with ``has_vector``; only ids of vectors are read and shuffled."""
    known = vectors.filter(F.col("embedding").isNotNull()).select("id", F.lit(True).alias("known")).distinct()
    return chunks.join(known, "id", "left").withColumn("has_vector", F.coalesce("known", F.lit(False))).drop("known")


def embed_batches(chunks: DataFrame, embed: Callable[[pa.Array], pa.Array], text: str = "content",
                  key: str = "id") -> DataFrame:
    """``(id, embedding)`` from a caller's function over Arrow batches of texts.

    ``embed`` returns one ``list<float>`` per text, null where it failed. An exception fails the chunks of its
    batch only, not the job.
    """
    source = chunks.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = pa.list_(pa.float32())
        for batch in batches:
            try:
                out = embed(batch.column(text)).cast(vector)
            except Exception:  # the caller's function may raise anything; its batch counts as failed
                out = pa.nulls(batch.num_rows, vector)
            yield pa.RecordBatch.from_arrays([batch.column(key), out], names=[key, "embedding"])

    return source.mapInArrow(run, f"{key} {kind}, embedding array<float>")


def mark_outcomes(chunks: DataFrame, documents: DataFrame, vectors: DataFrame,
                  retry_failed: bool = False) -> DataFrame:
    """Chunks after a vectorising job: with a vector done, without one failed, others as they were."""
    tried = pin(_vectorised(pending_chunks(chunks, documents, retry_failed).select("id"), vectors), "outcomes")
    # Few outcomes are broadcast, so that the chunks' texts are rewritten without a shuffle.
    return (chunks.join(broadcast_if(tried, tried.count(), _OUTCOME_BYTES), "id", "left")
            .withColumn("embedding_status",
                        F.when(F.col("has_vector"), fv.EMBEDDING_DONE)
                        .when(~F.col("has_vector"), fv.EMBEDDING_FAILED)
                        .otherwise(F.col("embedding_status")))
            .withColumn("vector_id",
                        F.when(F.col("has_vector"), codes.vector_id(F.col("id"))).otherwise(F.col("vector_id")))
            .drop("has_vector"))


def rollup(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Counts per active document of a vectorising job; zeros for a document without chunks."""
    live = (chunks.filter(F.col("status") == fv.ACTIVE)
            .select("id", "document_id", is_pending(retry_failed).alias("pending")))
    # Only pending chunks meet the vector table; the others need no join.
    tried = _vectorised(live.filter("pending"), vectors).select("document_id", "pending", "has_vector")
    others = live.filter("not pending").select("document_id", "pending", F.lit(False).alias("has_vector"))
    counts = tried.unionByName(others).groupBy("document_id").agg(
        F.count("*").alias("total"), F.count_if("pending").alias("pending"),
        F.count_if("has_vector").alias("success"))
    counted = active_documents(documents).join(counts, "document_id", "left")
    total, pending, success = (F.coalesce(name, F.lit(0)).cast("int") for name in ("total", "pending", "success"))
    return counted.select(
        "document_id", total.alias("total_chunk_count"), pending.alias("pending_chunk_count"),
        success.alias("success_count"), (pending - success).alias("failed_count"),
        (total - pending).alias("skipped_count"))


def new_tasks(documents: DataFrame) -> DataFrame:
    """One pending task per document, all counts zero."""
    zero = F.lit(0)
    return documents.select(
        F.col("id").alias("document_id"), "space_id", F.lit(fv.TASK_TYPE).alias("task_type"),
        F.lit(fv.STATUS_PENDING).alias("status"), zero.alias("total_chunk_count"),
        zero.alias("pending_chunk_count"), zero.alias("success_count"), zero.alias("failed_count"),
        zero.alias("skipped_count"), F.lit(None).cast("string").alias("error_message"))


def finished(counts: DataFrame) -> DataFrame:
    """Status, status text and message of rows with a job's counts."""
    total, success, failed, skipped = (
        F.coalesce(F.col(name), F.lit(0))
        for name in ("total_chunk_count", "success_count", "failed_count", "skipped_count"))
    status = codes.task_status(total, success, failed, skipped)
    return counts.withColumns({
        "status": status, "status_text": codes.status_text(status),
        "error_message": codes.task_message(total, success, failed, skipped)})


def finish_tasks(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """Tasks after their job. A task whose document is gone or inactive fails with that as its message."""
    from kbspark.functions.text import error_text

    names = ["total_chunk_count", "pending_chunk_count", "success_count", "failed_count", "skipped_count"]
    found = tasks.drop(*names, "status", "error_message").join(
        counts.withColumn("found", F.lit(True)), "document_id", "left")
    for name in names:
        found = found.withColumn(name, F.coalesce(name, F.lit(0)))
    known = F.coalesce("found", F.lit(False))
    done = finished(found)
    return (done
            .withColumn("status", F.when(known, F.col("status")).otherwise(fv.STATUS_FAILED))
            .withColumn("status_text", codes.status_text(F.col("status")))
            .withColumn("error_message", F.when(known, F.col("error_message"))
                        .otherwise(error_text(F.lit("document not found"))))
            .drop("found"))


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone or inactive."""
    live = chunks.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("chunk_id"))
    return vectors.join(live, "chunk_id", "left_anti")


def compact_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vector table without orphans."""
    live = chunks.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("chunk_id"))
    return vectors.join(live, "chunk_id", "left_semi")
