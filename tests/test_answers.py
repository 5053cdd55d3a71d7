"""Vectorising, answers and history on small tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark import fixed_values as fv
from kbspark.operators import answer, history, listing, numbering, vectorize

CHUNK = ("id long, document_id long, space_id long, chunk_index int, content string, embedding_status int, "
         "vector_id string, status int")


@pytest.fixture(scope="module")
def work(spark):
    chunks = spark.createDataFrame(
        [(1, 1, 1, 0, "good", 0, None, 1), (2, 1, 1, 1, "bad", 0, None, 1), (3, 1, 1, 2, "done", 1, "v", 1),
         (4, 1, 1, 3, "once failed", 2, None, 1), (5, 1, 1, 4, "gone", 0, None, 0), (6, 2, 1, 0, "bad", 0, None, 1),
         (7, 3, 1, 0, "good", 0, None, 1), (8, 5, 1, 0, "good", 0, None, 1)], CHUNK)
    documents = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 1), (5, 1, 1)],
                                      "id long, space_id long, status int")
    return chunks, documents


def test_vectorising(spark, work):
    def embed(texts):
        return pa.array([None if text.as_py() == "bad" else [1.0, float(len(text.as_py()))] for text in texts])

    chunks, documents = work
    pending = vectorize.pending_chunks(chunks, documents)
    assert sorted(row.id for row in pending.collect()) == [1, 2, 6, 8]
    assert sorted(row.id for row in vectorize.pending_chunks(chunks, documents, retry_failed=True).collect()) == [
        1, 2, 4, 6, 8]
    vectors = vectorize.embed_batches(pending, embed)
    assert {row.id: row.embedding for row in vectors.collect()} == {1: [1.0, 4.0], 2: None, 6: None, 8: [1.0, 4.0]}
    after = {row.id: (row.embedding_status, row.vector_id is not None)
             for row in vectorize.mark_outcomes(chunks, documents, vectors).collect()}
    assert after == {1: (1, True), 2: (2, False), 3: (1, True), 4: (2, False), 5: (0, False), 6: (2, False),
                     7: (0, False), 8: (1, True)}
    counts = vectorize.rollup(chunks, documents, vectors)
    assert {row.document_id: tuple(row)[1:] for row in counts.collect()} == {
        1: (4, 2, 1, 1, 2), 2: (1, 1, 0, 1, 0), 4: (0, 0, 0, 0, 0), 5: (1, 1, 1, 0, 0)}
    tasks = {row.document_id: (row.status, row.status_text, row.error_message)
             for row in vectorize.finish_tasks(vectorize.new_tasks(documents), counts).collect()}
    assert tasks == {
        1: (4, "partial_success", fv.SOME_FAILED_MESSAGE), 2: (3, "failed", fv.ALL_FAILED_MESSAGE),
        3: (3, "failed", "document not found"), 4: (3, "failed", fv.NO_CHUNKS_MESSAGE), 5: (2, "success", None)}


def test_a_failing_batch_fails_its_chunks_only(spark, work):
    def broken(texts):
        raise RuntimeError("no model")

    pending = vectorize.pending_chunks(*work)
    assert {row.embedding for row in vectorize.embed_batches(pending, broken).collect()} == {None}


def test_orphans(spark, work):
    vectors = spark.createDataFrame([(1, 1), (5, 1), (99, 1)], "chunk_id long, space_id long")
    assert sorted(row.chunk_id for row in vectorize.orphan_vectors(vectors, work[0]).collect()) == [5, 99]
    assert [row.chunk_id for row in vectorize.compact_vectors(vectors, work[0]).collect()] == [1]


@pytest.fixture(scope="module")
def asked(spark):
    questions = spark.createDataFrame([(1, "why?"), (2, "nothing?")], "query_id long, question string")
    hits = spark.createDataFrame(
        [(1, 2, 20, 9, 1, None, "x" * 2005, 0.5), (1, 1, 10, None, 1, 3, " first\r\nline ", 0.9)],
        "query_id long, rank int, chunk_id long, document_id long, space_id long, chunk_index int, content string, "
        "score double")
    return questions, hits


def test_prompt(spark, asked):
    rows = answer.prompts(*asked).collect()
    assert [row.query_id for row in rows] == [1]
    body = ("\n[Reference 1]\nChunk ID: 10\nChunk Index: 3\nContent:\n first\r\nline \n"
            "\n[Reference 2]\nDocument ID: 9\nChunk ID: 20\nContent:\n" + "x" * 2000 + "...\n")
    assert rows[0].prompt == fv.PROMPT_HEADER + "why?" + fv.PROMPT_CONTEXT + body + fv.PROMPT_FOOTER
    said = answer.generate_answers(answer.prompts(*asked), lambda prompts: pa.array([f"{len(p)}" for p in prompts.to_pylist()]))
    assert [tuple(row) for row in said.collect()] == [(1, str(len(rows[0].prompt)))]


def test_responses(spark, asked):
    answers = spark.createDataFrame([(1, "because"), (2, "must not be used")], "query_id long, answer string")
    rows = {row.query_id: row for row in answer.responses(*asked, answers).collect()}
    assert rows[1].answer == "because" and rows[1].reference_count == 2
    assert [(r.reference_index, r.chunk_id, r.content_preview) for r in rows[1].references] == [
        (1, 10, "first  line"), (2, 20, "x" * 300 + "...")]
    assert (rows[2].answer, rows[2].reference_count, rows[2].references) == (fv.NO_HIT_ANSWER, 0, [])


def test_ask_limits(spark):
    asks = spark.createDataFrame(
        [(1, 1, "q", None), (2, 1, "q", 0), (3, 1, "q", 50), (4, None, "q", 1), (5, 1, " ", 1), (6, 1, "q", 3)],
        "query_id long, space_id long, question string, top_k int")
    assert {row.query_id: row.top_k for row in answer.search_requests(asks).collect()} == {1: 5, 2: 5, 3: 10, 6: 3}
    assert {row.query_id: row.error for row in answer.rejected_asks(asks).collect()} == {
        4: "space_id missing", 5: "question blank"}


def test_history(spark):
    sessions = spark.createDataFrame(
        [(1, 1, "one", 1, "2024-01-01 00:00:00"), (2, 1, "two", 0, "2024-01-01 00:00:00"),
         (3, 2, "three", 1, "2024-01-01 00:00:00")],
        "id long, space_id long, title string, status int, t string").selectExpr(
        "id", "space_id", "title", "status", "cast(t as timestamp_ntz) updated_at",
        "cast(t as timestamp_ntz) created_at")
    asks = spark.createDataFrame(
        [(1, 1, None, " new one "), (2, 1, 1, "q"), (3, 1, 2, "q"), (4, 1, 3, "q"), (5, 1, 9, "q")],
        "query_id long, space_id long, session_id long, question string")
    rows = {row.query_id: (row.is_new_session, row.title, row.session_error)
            for row in history.resolve_sessions(asks, sessions).collect()}
    assert rows == {1: (True, "new one", None), 2: (False, None, None), 3: (False, None, "session not found"),
                    4: (False, None, "session of another space"), 5: (False, None, "session not found")}
    answered = spark.createDataFrame([(7, 1, 1, "q", None)],
                                     "query_id long, session_id long, space_id long, question string, answer string")
    assert [(row.position, row.role, row.content) for row in
            history.answered_messages(answered).orderBy("position").collect()] == [
        (0, "user", "q"), (1, "assistant", "")]
    messages = spark.sql("""
        select * from values (2L, 1L, 1L, 'assistant', 'a', timestamp_ntz'2024-01-01 00:00:05'),
        (1L, 1L, 1L, 'user', 'q', timestamp_ntz'2024-01-01 00:00:05'),
        (4L, 1L, 1L, 'assistant', 'b', timestamp_ntz'2024-01-01 00:00:01'),
        (5L, 2L, 1L, 'user', 'hidden', timestamp_ntz'2024-01-01 00:00:01')
        as t(id, session_id, space_id, role, content, created_at)""")
    references = spark.createDataFrame(
        [(12, 2, 2, 20), (11, 2, 1, 10)], "id long, message_id long, reference_index int, chunk_id long").selectExpr(
        "*", "1L document_id", "1L space_id", "0 chunk_index", "0.5D score", "'p' content_preview")
    told = history.session_history(sessions, messages, references).collect()
    assert [(row.message_id, row.references and [r.chunk_id for r in row.references]) for row in told] == [
        (4, []), (1, None), (2, [10, 20])]
    assert [row.id for row in listing.messages(messages, sessions).collect()] == [4, 1, 2]
    touched = history.touch_sessions(sessions, messages.withColumnRenamed("created_at", "asked_at"))
    assert {row.id: row.updated_at.second for row in touched.collect()} == {1: 5, 2: 1, 3: 0}


def test_numbers_have_no_gaps(spark):
    import hashlib

    rows = spark.range(5000).selectExpr("id key", "id % 4 need").repartition(7)
    blocks = {"first": (F.col("need"), F.lit(10)), "single": (F.lit(1), F.lit(1))}
    found = numbering.numbered(rows, "key", blocks).orderBy("single").collect()
    order = sorted(range(5000), key=lambda n: hashlib.md5(str(n).encode()).hexdigest())
    assert [row.key for row in found] == order and [row.single for row in found] == list(range(1, 5001))
    free = 10
    for row in found:
        assert row.first == free
        free += row.need
    assert numbering.numbered(rows.limit(0), "key", blocks).collect() == []


def test_saved_batch(spark):
    reference = "struct<reference_index int, chunk_id long, document_id long, space_id long, chunk_index int, score double, content_preview string>"
    at = "timestamp_ntz'2024-01-02 00:00:0{}'"
    asks = spark.sql(f"""
        select * from values (1L, 1L, null, ' open ', {at.format(1)}), (2L, 1L, 1L, 'again', {at.format(2)}),
        (3L, null, null, 'no space', {at.format(3)}), (4L, 1L, null, ' ', {at.format(4)}), (5L, 1L, 7L, 'lost', {at.format(5)}),
        (6L, 1L, 1L, 'unanswered', {at.format(6)}), (7L, 1L, null, 'second new one', {at.format(7)})
        as t(query_id, space_id, session_id, question, asked_at)""").withColumn("extra", F.lit("clash"))
    cited = [(None, 10, 1, 1, 0, 0.5, "p"), (5, 11, 1, 1, 1, 0.4, "q")]
    answers = spark.createDataFrame([(1, "yes", cited), (2, None, None), (3, "x", []), (4, "x", []), (5, "x", []), (7, "z", cited[:1])],
                                    f"query_id long, answer string, references array<{reference}>")
    sessions = spark.sql("select 1L id, 1L space_id, 'one' title, 1 status, timestamp_ntz'2024-01-01' created_at, "
                         "timestamp_ntz'2024-01-01' updated_at")
    messages, references = spark.sql("select 40L id"), spark.sql("select 90L id")
    saved = history.save(asks, answers, sessions, messages, references)
    assert {row.query_id: row.error for row in saved.rejects.collect()} == {
        3: "space_id missing", 4: "question blank", 5: "session not found", 6: "answer missing"}
    ids = {row.query_id: row for row in saved.results.collect()}
    assert ids[2].session_id == 1 and {ids[1].session_id, ids[7].session_id} == {2, 3}
    assert sorted(row.user_message_id for row in ids.values()) == [41, 43, 45]
    told = {row.id: row for row in saved.messages.collect()}
    assert sorted(told) == list(range(41, 47))
    for key, question, said in ((1, " open ", "yes"), (2, "again", ""), (7, "second new one", "z")):
        user, assistant = told[ids[key].user_message_id], told[ids[key].assistant_message_id]
        assert (user.role, user.content, assistant.role, assistant.content) == ("user", question, "assistant", said)
        assert user.session_id == assistant.session_id == ids[key].session_id and user.created_at.second == key
    kept = {(row.message_id, row.reference_index): (row.id, row.chunk_id) for row in saved.references.collect()}
    assert set(kept) == {(ids[1].assistant_message_id, 1), (ids[1].assistant_message_id, 5), (ids[7].assistant_message_id, 1)}
    assert sorted(n for n, _ in kept.values()) == [91, 92, 93]
    after = {row.id: row for row in saved.sessions.collect()}
    assert after[1].updated_at.second == 2 and after[ids[1].session_id].title == "open" and len(after) == 3
    empty = history.save(asks.limit(0), answers.limit(0), sessions.limit(0), messages.limit(0), references.limit(0))
    assert [part.count() for part in empty] == [0, 0, 0, 0, 0]
