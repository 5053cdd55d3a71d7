"""Change feeds and embedding outcomes committed to versioned tables: only touched partitions are read and written."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.operators import gram_index, ingest, vectorize
from kbspark.operators.limits import broadcast_if, pin
from kbspark.sources.versions import Part, Versions


class Committed(NamedTuple):
    version: int
    touched: list[Part]
    rejects: DataFrame


def _listed(parts: DataFrame) -> list[Part]:
    return [Part(row["space_id"], row["block"]) for row in parts.select("space_id", "block").distinct().collect()]


def commit_changes(store: Versions, changes: DataFrame, spaces: DataFrame, at: Column | None = None,
                   max_size: int = fv.CHUNK_MAX_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Committed:
    """Applies a feed, as ``ingest.apply_document_changes`` does, to the newest version of documents and chunks.

    Changes are judged against three columns of all documents; only the partitions where a changed document lies, or
    moves to, are read with their texts and written anew. Documents, chunks and stored grams change in one version. Documents that
    are written or deleted get ``at`` (the time now) as ``updated_at``, new ones also as ``created_at``. A feed without
    a valid change makes no version. A ``CommitConflict`` means: nothing was changed, apply the feed again.
    """
    at = F.current_timestamp().cast("timestamp_ntz") if at is None else at
    base = store.current()
    judged = pin(ingest.judge_changes(store.read("kb_document", base), changes, spaces), "judged-changes")
    valid = judged.filter(F.col("reason").isNull()).withColumn("block", store.block(F.col("id")))
    touched = _listed(valid.select("block", F.explode(F.array_compact(F.array("old_space", "space_id"))).alias("space_id")))
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "op", "id", "reason")
    if not touched:
        return Committed(base, [], rejects)
    documents, chunks = (store.read(name, base, touched) for name in ("kb_document", "kb_chunk"))
    changed = ingest.apply_document_changes(documents, chunks, changes, spaces, max_size, overlap, judged=judged)
    ids = pin(valid.select("id").distinct().withColumn("changed", F.lit(True)), "changed-ids")
    stamped = changed.documents.join(broadcast_if(ids, ids.count(), 64), "id", "left").withColumns({
        "created_at": F.when(F.col("changed"), F.coalesce("created_at", at)).otherwise(F.col("created_at")),
        "updated_at": F.when(F.col("changed"), at).otherwise(F.col("updated_at"))})
    tables = {"kb_document": stamped, "kb_chunk": changed.chunks}
    if "chunk_gram" in store.parts(base):
        rebuilt = pin(changed.chunks, "rebuilt-chunks")
        tables |= {"kb_chunk": rebuilt, "chunk_gram": gram_index.grams_of(
            rebuilt.withColumn("block", store.block(F.col("document_id"))), store.block_documents, packed=True)}
    return Committed(store.commit(base, tables, touched), touched, rejects)


def commit_outcomes(store: Versions, vectors: DataFrame, retry_failed: bool = False) -> Committed:
    """Marks pending chunks by the vectors ``(id, embedding)`` that came for them; writes only partitions that have any."""
    base = store.current()
    pending = vectorize.pending_chunks(store.read("kb_chunk", base), store.read("kb_document", base), retry_failed)
    touched = _listed(pending.withColumn("block", store.block(F.col("document_id"))))
    if touched:
        documents, chunks = (store.read(name, base, touched) for name in ("kb_document", "kb_chunk"))
        after = vectorize.mark_outcomes(chunks, documents, vectors, retry_failed)
        base = store.commit(base, {"kb_chunk": after}, touched)
    return Committed(base, touched, store.spark.createDataFrame([], "seq long, op string, id long, reason string"))
