"""Question-and-answer history: sessions, messages and references of a batch of answered questions."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import text as tx
from kbspark.operators.limits import pin
from kbspark.operators.numbering import numbered


def resolve_sessions(asks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Asks ``(query_id, space_id, session_id, question)`` with ``session_error`` and, for new sessions, a title.

    A given session must be active and of the ask's space; without one the ask opens a new session.
    """
    known = sessions.select(
        F.col("id").alias("session_id"), F.col("space_id").alias("_space"), F.col("status").alias("_status"))
    given = F.col("session_id").isNotNull()
    active = F.coalesce(F.col("_status") == fv.ACTIVE, F.lit(False))
    error = (F.when(given & ~active, "session not found")
             .when(given & ~F.col("_space").eqNullSafe(F.col("space_id")), "session of another space"))
    return (asks.join(known, "session_id", "left")
            .withColumns({
                "session_error": error, "is_new_session": ~given,
                "title": F.when(~given, tx.session_title(F.col("question")))})
            .drop("_space", "_status"))


def answered_messages(answered: DataFrame) -> DataFrame:
    """A user and an assistant message per answered question ``(query_id, session_id, space_id, question, answer)``."""
    pair = F.array(
        F.struct(F.lit(0).alias("position"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("position"), F.lit("assistant").alias("role"),
                 F.coalesce("answer", F.lit("")).alias("content")))
    return answered.select("query_id", "session_id", "space_id", F.explode(pair).alias("m")).select(
        "query_id", "session_id", "space_id", "m.position", "m.role", "m.content")


def reference_rows(answered: DataFrame) -> DataFrame:
    """One row per nested reference of ``(query_id, session_id, references)``; a missing index is its position."""
    entries = answered.select("query_id", "session_id", F.posexplode("references").alias("_at", "r"))
    index = F.coalesce("r.reference_index", F.col("_at") + 1)
    return entries.select(
        "query_id", "session_id", index.alias("reference_index"), "r.chunk_id", "r.document_id", "r.space_id",
        "r.chunk_index", "r.score", "r.content_preview")


def touch_sessions(sessions: DataFrame, asks: DataFrame) -> DataFrame:
    """Sessions with ``updated_at`` moved to their latest ask ``(session_id, asked_at)``."""
    newest = asks.groupBy("session_id").agg(F.max("asked_at").alias("_asked")).withColumnRenamed("session_id", "id")
    return (sessions.join(newest, "id", "left")
            .withColumn("updated_at", F.coalesce("_asked", "updated_at")).drop("_asked"))


def session_history(sessions: DataFrame, messages: DataFrame, references: DataFrame) -> DataFrame:
    """Messages of active sessions in order, each with its nested, ordered references.

    Assistant messages have a list, often empty; others have none. Only the references of one message are collected
    (at most the ask limit of them). A session's messages stay rows, so that a session of any length is sorted by
    many tasks instead of being gathered in one.
    """
    fields = ["reference_index", "id", "chunk_id", "document_id", "space_id", "chunk_index", "score",
              "content_preview"]
    nested = references.groupBy(F.col("message_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("references"))
    session = sessions.filter(F.col("status") == fv.ACTIVE).select(
        F.col("id").alias("session_id"), F.col("title").alias("session_title"),
        F.col("updated_at").alias("session_updated_at"))
    none = F.array().cast(nested.schema["references"].dataType)
    listed = F.when(F.col("role") == "assistant", F.coalesce("references", none))
    return (messages.join(session, "session_id").join(nested, "id", "left")
            .select("session_id", "session_title", "session_updated_at", F.col("id").alias("message_id"), "role",
                    "content", "created_at", listed.alias("references"))
            .orderBy("session_id", "created_at", "message_id"))


# --- saving a batch -------------------------------------------------------------------------------------------

class Saved(NamedTuple):
    """What a batch of answered asks adds to the history."""

    results: DataFrame
    """``query_id, session_id, user_message_id, assistant_message_id`` of the asks that were saved."""
    sessions: DataFrame
    """All sessions as they are afterwards: the old ones, touched, and the new ones."""
    messages: DataFrame
    """New messages."""
    references: DataFrame
    """New references."""
    rejects: DataFrame
    """``query_id, error`` of the asks that were not saved."""


def _next_id(rows: DataFrame) -> int:
    return (rows.agg(F.max("id")).first()[0] or 0) + 1


def _messages(kept: DataFrame) -> DataFrame:
    carried = kept.withColumn("query_id", F.struct("user_message_id", "asked_at"))
    return answered_messages(carried).select(
        (F.col("query_id.user_message_id") + F.col("position")).alias("id"), "session_id", "space_id", "role", "content",
        F.col("query_id.asked_at").alias("created_at"))


def _references(kept: DataFrame) -> DataFrame:
    entries = kept.select("assistant_message_id", "session_id", "_reference", "asked_at",
                          F.posexplode("references").alias("_at", "r"))
    index = F.coalesce("r.reference_index", F.col("_at") + 1)
    return entries.select(
        (F.col("_reference") + F.col("_at")).alias("id"), F.col("assistant_message_id").alias("message_id"), "session_id",
        index.alias("reference_index"), "r.chunk_id", "r.document_id", "r.space_id", "r.chunk_index", "r.score",
        "r.content_preview", F.col("asked_at").alias("created_at"))


def save(asks: DataFrame, answers: DataFrame, sessions: DataFrame, messages: DataFrame, references: DataFrame) -> Saved:
    """The rows that a batch of asks adds to ``sessions``, ``messages`` and ``references``, with ids and times.

    ``asks`` has ``query_id, space_id, session_id, question, asked_at``, with a unique ``query_id``; ``answers`` has
    ``query_id, answer, references``. An ask without a space, a visible question, an answer row or a usable session is
    rejected; an answer may be null, and so may its references. Of the stored messages and references only the highest
    ids are read. New ids follow these without gaps, those of an ask's question before those of its answer, in an order
    that rests on the query ids alone; the asks are shuffled once for it, and no list of rows is built. An ask without a
    session opens one of its own. Two batches must not be saved side by side: they would take the same ids.
    """
    said = answers.select("query_id", "answer", "references", F.lit(True).alias("_answered"))
    judged = resolve_sessions(asks.select("query_id", "space_id", "session_id", "question", "asked_at"), sessions)
    error = (F.when(F.col("space_id").isNull(), "space_id missing")
             .when(~tx.has_text(F.col("question")), "question blank")
             .when(F.col("_answered").isNull(), "answer missing").otherwise(F.col("session_error")))
    full = pin(judged.join(said, "query_id", "left").withColumn("error", error).drop("session_error", "_answered"),
               "answered-asks")
    blocks = {"_session": (F.col("is_new_session").cast("long"), F.lit(_next_id(sessions)).cast("long")),
              "user_message_id": (F.lit(2), F.lit(_next_id(messages)).cast("long")),
              "_reference": (F.coalesce(F.size("references"), F.lit(0)), F.lit(_next_id(references)).cast("long"))}
    kept = numbered(full.filter(F.col("error").isNull()).drop("error"), "query_id", blocks)
    kept = pin(kept.withColumns({"session_id": F.coalesce("session_id", "_session"),
                                 "assistant_message_id": F.col("user_message_id") + 1}), "saved-asks")
    opened = kept.filter("is_new_session").select(
        F.col("session_id").alias("id"), "space_id", "title", F.lit(fv.ACTIVE).alias("status"),
        F.col("asked_at").alias("created_at"), F.col("asked_at").alias("updated_at"))
    old = touch_sessions(sessions, kept.filter(~F.col("is_new_session")).select("session_id", "asked_at"))
    return Saved(
        kept.select("query_id", "session_id", "user_message_id", "assistant_message_id"),
        old.unionByName(opened, allowMissingColumns=True), _messages(kept), _references(kept),
        full.filter(F.col("error").isNotNull()).select("query_id", "error"))
