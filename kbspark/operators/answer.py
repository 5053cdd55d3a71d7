"""Answer context of retrieved chunks: parameters, prompts, numbered references, no-hit answers."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import text as tx


def ask_top_k(top_k: Column) -> Column:
    return F.when(top_k > 0, F.least(top_k, F.lit(fv.ASK_TOP_K_MAX))).otherwise(fv.DEFAULT_TOP_K)


def ask_error(space_id: Column, question: Column) -> Column:
    return (F.when(space_id.isNull(), "space_id missing")
            .when(~tx.has_text(question), "question blank"))


def search_requests(asks: DataFrame) -> DataFrame:
    """Search queries of the valid asks ``(query_id, space_id, question, …)``."""
    return (asks.filter(ask_error(F.col("space_id"), F.col("question")).isNull())
            .withColumn("top_k", ask_top_k(F.col("top_k")))
            .withColumnRenamed("question", "query"))


def rejected_asks(asks: DataFrame) -> DataFrame:
    error = ask_error(F.col("space_id"), F.col("question"))
    return asks.select("query_id", error.alias("error")).filter(F.col("error").isNotNull())


def _ranked(items: Column) -> Column:
    """Collect a query's hits in rank order. A query has at most ``top_k`` of them."""
    return F.sort_array(F.collect_list(items))


def _line(label: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(label), value.cast("string"), F.lit("\n")), F.lit(""))


def context_block(hit: Column) -> Column:
    return F.concat(
        F.lit("\n[Reference "), hit["rank"].cast("string"), F.lit("]\n"),
        _line("Document ID: ", hit["document_id"]), _line("Chunk ID: ", hit["chunk_id"]),
        _line("Chunk Index: ", hit["chunk_index"]),
        F.lit("Content:\n"), tx.context_text(hit["content"]), F.lit("\n"))


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompt text per question ``(query_id, question)`` that has hits."""
    fields = ["rank", "document_id", "chunk_id", "chunk_index", "content"]
    per_query = hits.groupBy("query_id").agg(_ranked(F.struct(*fields)).alias("hits"))
    text = F.concat(
        F.lit(fv.PROMPT_HEADER), "question", F.lit(fv.PROMPT_CONTEXT),
        F.concat_ws("", F.transform("hits", context_block)), F.lit(fv.PROMPT_FOOTER))
    return questions.join(per_query, "query_id").select("query_id", "question", text.alias("prompt"))


def references(hits: DataFrame) -> DataFrame:
    """One numbered reference per hit."""
    return hits.select(
        "query_id", F.col("rank").alias("reference_index"), "chunk_id", "document_id", "space_id", "chunk_index",
        "score", tx.preview(F.col("content")).alias("content_preview"))


def generate_answers(prompt_rows: DataFrame, generate: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``(query_id, answer)`` from a caller's function over Arrow batches of prompts."""
    source = prompt_rows.select("query_id", "prompt")
    kind = source.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), generate(batch.column("prompt")).cast(pa.string())],
                names=["query_id", "answer"])

    return source.mapInArrow(run, f"query_id {kind}, answer string")


def responses(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: answer, reference count, nested references.

    A question without hits gets the fixed answer and an empty list, whatever ``answers`` holds.
    """
    fields = ["reference_index", "chunk_id", "document_id", "space_id", "chunk_index", "score", "content_preview"]
    nested = references(hits).groupBy("query_id").agg(_ranked(F.struct(*fields)).alias("references"))
    found = questions.join(nested, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    hit = F.col("references").isNotNull()
    none = F.array().cast(nested.schema["references"].dataType)
    return found.select(
        *questions.columns, F.when(hit, F.col("answer")).otherwise(fv.NO_HIT_ANSWER).alias("answer"),
        F.when(hit, F.size("references")).otherwise(0).alias("reference_count"),
        F.coalesce("references", none).alias("references"))
