"""Referential checks as one report."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kbspark import fixed_values as fv


def _without(rows: DataFrame, key: str, parents: DataFrame, rule: str, table: str) -> DataFrame:
    """Rows whose ``key`` is in no row of ``parents``. A parent most rows share is split by the skew join."""
    missing = rows.filter(F.col(key).isNotNull()).select("id", key).join(
        parents.select(F.col("id").alias(key)), key, "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), "id")


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, table_name, id)`` for every row that breaks a rule between the given tables.

    Active rows must have an active parent; history rows need an existing one. Rules between tables that are not
    given are left out.
    """
    active = {name: rows.filter(F.col("status") == fv.ACTIVE)
              for name, rows in tables.items() if "status" in rows.columns}
    edges = [
        ("kb_document", "space_id", "kb_space", "space not found"),
        ("kb_chunk", "document_id", "kb_document", "document not found"),
        ("qa_session", "space_id", "kb_space", "space not found"),
        ("eval_dataset", "space_id", "kb_space", "space not found"),
        ("eval_case", "dataset_id", "eval_dataset", "dataset not found"),
    ]
    parts = [_without(active[child], key, active[parent], rule, child)
             for child, key, parent, rule in edges if child in tables and parent in tables]
    plain = [
        ("kb_embedding_task", "document_id", "kb_document", "document not found"),
        ("qa_message", "session_id", "qa_session", "session not found"),
        ("qa_reference", "message_id", "qa_message", "message not found"),
        ("eval_run", "dataset_id", "eval_dataset", "dataset not found"),
        ("eval_case_result", "run_id", "eval_run", "run not found"),
    ]
    parts += [_without(tables[child], key, tables[parent], rule, child)
              for child, key, parent, rule in plain if child in tables and parent in tables]
    if "qa_message" in tables and "qa_session" in tables:
        owner = tables["qa_session"].select(F.col("id").alias("session_id"), F.col("space_id").alias("owner_space"))
        parts.append(tables["qa_message"].join(owner, "session_id").filter("space_id <> owner_space").select(
            F.lit("session of another space").alias("rule"), F.lit("qa_message").alias("table_name"), "id"))
    if "kb_chunk" in tables and "kb_document" in tables:
        owner = active["kb_document"].select(
            F.col("id").alias("document_id"), F.col("space_id").alias("owner_space"))
        parts.append(active["kb_chunk"].join(owner, "document_id").filter("space_id <> owner_space").select(
            F.lit("document of another space").alias("rule"), F.lit("kb_chunk").alias("table_name"), "id"))
    return reduce(DataFrame.unionByName, parts)
