"""Spark schemas of the knowledge-base tables, and how each one is laid out on disk."""

from pyspark.sql import types as T

_LONG, _INT, _STR, _DOUBLE, _TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType())


def _table(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_STAMPS = (("created_at", _TS), ("updated_at", _TS))

TABLES = {
    "kb_space": _table(
        ("id", _LONG), ("name", _STR), ("description", _STR), ("status", _INT), *_STAMPS),
    "kb_document": _table(
        ("id", _LONG), ("space_id", _LONG), ("title", _STR), ("content", _STR), ("source_type", _STR),
        ("source_uri", _STR), ("status", _INT), ("chunk_count", _INT), *_STAMPS),
    "kb_chunk": _table(
        ("id", _LONG), ("document_id", _LONG), ("space_id", _LONG), ("chunk_index", _INT),
        ("content", _STR), ("char_count", _INT), ("embedding_status", _INT), ("vector_id", _STR),
        ("status", _INT), *_STAMPS),
    "chunk_vector": _table(
        ("vector_id", _STR), ("chunk_id", _LONG), ("document_id", _LONG), ("space_id", _LONG),
        ("chunk_index", _INT), ("source", _STR), ("embedding", T.ArrayType(T.FloatType()))),
    "kb_embedding_task": _table(
        ("id", _LONG), ("document_id", _LONG), ("space_id", _LONG), ("task_type", _STR), ("status", _INT),
        ("total_chunk_count", _INT), ("pending_chunk_count", _INT), ("success_count", _INT),
        ("failed_count", _INT), ("skipped_count", _INT), ("error_message", _STR), ("started_at", _TS),
        ("finished_at", _TS), *_STAMPS),
    "qa_session": _table(
        ("id", _LONG), ("space_id", _LONG), ("title", _STR), ("status", _INT), *_STAMPS),
    "qa_message": _table(
        ("id", _LONG), ("session_id", _LONG), ("space_id", _LONG), ("role", _STR), ("content", _STR),
        ("created_at", _TS)),
    "qa_reference": _table(
        ("id", _LONG), ("message_id", _LONG), ("session_id", _LONG), ("reference_index", _INT),
        ("chunk_id", _LONG), ("document_id", _LONG), ("space_id", _LONG), ("chunk_index", _INT),
        ("score", _DOUBLE), ("content_preview", _STR), ("created_at", _TS)),
    "eval_dataset": _table(
        ("id", _LONG), ("space_id", _LONG), ("name", _STR), ("description", _STR), ("status", _INT), *_STAMPS),
    "eval_case": _table(
        ("id", _LONG), ("dataset_id", _LONG), ("question", _STR), ("expected_answer", _STR),
        ("expected_chunk_ids", T.ArrayType(_LONG)), ("expected_keywords", T.ArrayType(_STR)),
        ("difficulty", _STR), ("status", _INT), *_STAMPS),
    "eval_run": _table(
        ("id", _LONG), ("dataset_id", _LONG), ("run_name", _STR), ("retrieval_mode", _STR), ("top_k", _INT),
        ("candidate_k", _INT), ("vector_weight", _DOUBLE), ("keyword_weight", _DOUBLE),
        ("enable_answer_generation", _INT), ("status", _INT), ("total_case_count", _INT),
        ("success_case_count", _INT), ("failed_case_count", _INT), ("avg_recall_at_k", _DOUBLE),
        ("hit_rate_at_k", _DOUBLE), ("mrr", _DOUBLE), ("avg_answer_keyword_hit", _DOUBLE),
        ("citation_correct_rate", _DOUBLE), ("avg_latency_ms", _DOUBLE), ("error_message", _STR),
        ("started_at", _TS), ("ended_at", _TS), *_STAMPS),
    "eval_case_result": _table(
        ("id", _LONG), ("run_id", _LONG), ("case_id", _LONG), ("question", _STR), ("answer", _STR),
        ("retrieved_chunk_ids", T.ArrayType(_LONG)), ("reference_chunk_ids", T.ArrayType(_LONG)),
        ("recall_at_k", _DOUBLE), ("hit_at_k", _INT), ("mrr", _DOUBLE), ("answer_keyword_hit", _DOUBLE),
        ("citation_correct", _INT), ("grounded", _INT), ("latency_ms", _LONG), ("error_message", _STR),
        *_STAMPS),
}

# Sort order inside each file, so that Parquet min/max statistics prune on it.
SORT_KEYS = {
    "kb_document": ["id"],
    "kb_chunk": ["document_id", "chunk_index"],
    "chunk_vector": ["document_id", "chunk_index"],
    "qa_message": ["session_id", "created_at", "id"],
    "qa_reference": ["message_id", "reference_index"],
    "eval_case": ["dataset_id", "id"],
    "eval_case_result": ["run_id", "id"],
}
