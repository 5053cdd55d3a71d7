"""Listings of the tables, in the order users see them. Global sorts are range-partitioned, so no task takes all."""

from pyspark.sql import DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.operators.limits import pin
from kbspark.operators.lookup import looked_up

# Bytes of a broadcast parent: two ids and the hash-table entry.
_PARENT_BYTES = 96


def active(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == fv.ACTIVE)


def _of(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is active."""
    return rows.join(active(parents).select(F.col("id").alias(key)), key, "left_semi")


def spaces(kb_space: DataFrame) -> DataFrame:
    return active(kb_space).orderBy(F.desc("id"))


def documents(kb_document: DataFrame, space_id: int | None = None) -> DataFrame:
    rows = active(kb_document)
    if space_id is not None:
        rows = rows.filter(F.col("space_id") == space_id)
    return rows.orderBy(F.desc("id"))


def document_chunks(kb_chunk: DataFrame, kb_document: DataFrame) -> DataFrame:
    return _of(active(kb_chunk), kb_document, "document_id").orderBy("document_id", "chunk_index")


def document_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("document_id", F.desc("id"))


def sessions(qa_session: DataFrame) -> DataFrame:
    return active(qa_session).orderBy("space_id", F.desc("updated_at"), F.desc("created_at"))


def messages(qa_message: DataFrame, qa_session: DataFrame) -> DataFrame:
    return _of(qa_message, qa_session, "session_id").orderBy("session_id", "created_at", "id")


def references(qa_reference: DataFrame, qa_message: DataFrame) -> DataFrame:
    known = qa_message.select(F.col("id").alias("message_id"))
    return (qa_reference.join(known, "message_id", "left_semi")
            .orderBy("message_id", "reference_index", "id"))


def eval_datasets(eval_dataset: DataFrame) -> DataFrame:
    return active(eval_dataset).orderBy(F.desc("created_at"))


def eval_cases(eval_case: DataFrame, eval_dataset: DataFrame) -> DataFrame:
    return _of(active(eval_case), eval_dataset, "dataset_id").orderBy("dataset_id", "id")


def run_results(results: DataFrame, eval_run: DataFrame) -> DataFrame:
    known = eval_run.select(F.col("id").alias("run_id"))
    return results.join(known, "run_id", "left_semi").orderBy("run_id", "id")


# --- children of given parents --------------------------------------------------------------------------------

def children(rows: DataFrame, parents: DataFrame, given: DataFrame, key: str, only_active: bool = True,
             by_space: bool = False) -> DataFrame:
    """``rows`` whose ``key`` names one of the ``given`` parents ``(id)`` that exist and, by default, are active.

    The ids are few against the rows, which are not shuffled: the ids' range is a filter of the scan, for which files
    sorted by ``key`` are skipped, and the ids are broadcast, in slices beyond the bound. With ``by_space`` rows lie in
    their parent's space; tables partitioned by space are then pruned to the spaces of the given parents at run time.
    Repeated and null ids count once and not at all.
    """
    known = active(parents) if only_active else parents
    columns = [F.col("id").alias(key)] + ([F.col("space_id")] if by_space else [])
    wanted = pin(known.join(given.select("id").distinct(), "id", "left_semi").select(*columns), "parents")
    low, high, count = wanted.agg(F.min(key), F.max(key), F.count("*")).first()
    inside = F.col(key).between(low, high) if count else F.lit(False)
    return looked_up(rows.filter(inside), wanted, key, count, _PARENT_BYTES, ("space_id",) if by_space else ())


def unknown(parents: DataFrame, given: DataFrame, error: str, only_active: bool = True) -> DataFrame:
    """``(id, error)`` of the given ids that name no parent, or no active one."""
    known = (active(parents) if only_active else parents).select("id")
    return given.select("id").distinct().join(known, "id", "left_anti").select("id", F.lit(error).alias("error"))


def messages_of(qa_message: DataFrame, qa_session: DataFrame, given: DataFrame) -> DataFrame:
    return children(qa_message, qa_session, given, "session_id", by_space=True).orderBy("session_id", "created_at", "id")


def references_of(qa_reference: DataFrame, qa_message: DataFrame, given: DataFrame) -> DataFrame:
    found = children(qa_reference, qa_message, given, "message_id", only_active=False)
    return found.orderBy("message_id", "reference_index", "id")


def chunks_of(kb_chunk: DataFrame, kb_document: DataFrame, given: DataFrame) -> DataFrame:
    return children(active(kb_chunk), kb_document, given, "document_id", by_space=True).orderBy("document_id", "chunk_index")


def cases_of(eval_case: DataFrame, eval_dataset: DataFrame, given: DataFrame) -> DataFrame:
    return children(active(eval_case), eval_dataset, given, "dataset_id").orderBy("dataset_id", "id")


def results_of(results: DataFrame, eval_run: DataFrame, given: DataFrame) -> DataFrame:
    return children(results, eval_run, given, "run_id", only_active=False).orderBy("run_id", "id")
