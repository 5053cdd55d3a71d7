"""The named queries: each runs operators over the tables derived from one test-data folder."""

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import codes, scores, text as tx
from kbspark.operators import (answer, eval_store, evaluate, feed, gram_index, history, ingest, integrity, listing, retrieve,
                               vectorize)
from kbspark.operators.limits import pin
from kbspark.sources.folders import shared_folder
from kbspark.sources.shipping import ship
from kbspark.sources.tables import read_table, write_table
from kbspark.sources.testdata import KnowledgeBase, at_second, space_of
from kbspark.sources.versions import Versions
from kbspark.streaming import ingest as stream_ingest, rollup

BUILDERS: dict[str, Callable[[KnowledgeBase], DataFrame]] = {}


def query(build: Callable[[KnowledgeBase], DataFrame]) -> Callable[[KnowledgeBase], DataFrame]:
    BUILDERS[build.__name__] = build
    return build


def _over_test_data(build: Callable[[KnowledgeBase], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(KnowledgeBase(spark, sf_dir))

    return run


def _joined(values):
    """A list of ids as text, so that results compare as plain values."""
    return F.concat_ws(",", F.transform(values, lambda one: one.cast("string")))


def _text(timestamp: str):
    return F.col(timestamp).cast("string").alias(timestamp)


# --- ingest ---------------------------------------------------------------------------------------------------

@query
def chunk_documents(kb):
    return ingest.chunk_documents(kb.document_requests).select(
        "document_id", "space_id", "chunk_index", "content", "char_count")


@query
def document_chunk_counts(kb):
    return ingest.chunk_counts(kb.document_requests).select("id", "chunk_count")


@query
def default_source_type(kb):
    return ingest.prepare_documents(kb.document_requests).select("id", "title", "source_type", "status")


def _edited(kb):
    """Document requests with the fields a user may get wrong, told by the text itself."""
    return kb.document_requests.withColumns({
        "title": F.when(F.length("content") > 3000, F.substring("content", 1, 300))
        .when(F.length("content") < 200, " \t\n").otherwise(F.col("title")),
        "source_type": F.concat("source_type", F.substring("content", 1, 60)),
        "space_id": F.when(F.col("source_type") != "SRC3", F.col("space_id"))})


@query
def document_quality_violations(kb):
    return ingest.violations(_edited(kb), ingest.document_rules())


@query
def conforming_documents(kb):
    return ingest.conforming(_edited(kb), ingest.document_rules()).select("id", "title")


@query
def space_name_conflicts(kb):
    return ingest.space_name_conflicts(kb.named_spaces, kb.space_requests)


@query
def space_upsert(kb):
    after, _ = ingest.upsert_spaces(kb.named_spaces, kb.space_requests)
    return after


@query
def space_request_rejects(kb):
    _, rejects = ingest.upsert_spaces(kb.named_spaces, kb.space_requests)
    return rejects


def _documents_by_source(kb):
    return kb.raw("documents").join(
        kb.raw("labels").filter("quality = 0").select("doc_id").distinct().withColumn("poor", F.lit(True)),
        "doc_id", "left").select(
        (F.when(F.col("lang") == "en", 2).otherwise(4) * 100 + F.substring("source", 4, 9).cast("long"))
        .alias("space_id"),
        F.when(F.col("poor"), fv.DELETED).otherwise(fv.ACTIVE).alias("status"))


@query
def deletable_spaces(kb):
    return ingest.deletable_spaces(kb.named_spaces.withColumn("status", F.lit(1)), _documents_by_source(kb)).select(
        "id", "name")


@query
def space_delete_rejects(kb):
    ids = kb.named_spaces.select("id")
    asked = ids.unionByName(ids.select((F.col("id") + 1_000_000).alias("id")))
    spaces = kb.named_spaces.withColumn("status", F.lit(1))
    return ingest.space_delete_rejects(spaces, _documents_by_source(kb), asked)


@query
def space_soft_delete(kb):
    spaces = kb.named_spaces.withColumn("status", F.lit(1))
    return ingest.delete_spaces(spaces, _documents_by_source(kb), kb.named_spaces.select("id")).select("id", "status")


@query
def document_update_rebuild(kb):
    changed = ingest.apply_document_changes(kb.documents, kb.chunks, kb.changes, kb.spaces)
    return changed.chunks


@query
def document_update_rows(kb):
    changed = ingest.apply_document_changes(kb.documents, kb.chunks, kb.changes, kb.spaces)
    return changed.documents.select("id", "space_id", "title", "source_type", "source_uri", "status")


@query
def document_update_rejects(kb):
    return ingest.apply_document_changes(kb.documents, kb.chunks, kb.changes, kb.spaces).rejects


def _versions(kb):
    """Documents and chunks as versioned tables, for queries that read the chunks they are made of once more."""
    return _committed(kb.pin_chunks())


def _committed(kb):
    """Documents and chunks as versioned tables, in blocks of 250 documents."""
    store = Versions(kb.spark, shared_folder(kb.spark, "versions"), block_documents=250)
    store.commit(0, {"kb_document": kb.documents, "kb_chunk": kb.chunks})
    return store


@query
def document_feed_commit(kb):
    """Documents and chunks read back after the feed was committed to the partitions it touches."""
    store = _versions(kb)
    feed.commit_changes(store, kb.changes, kb.spaces)
    documents, chunks = store.read("kb_document"), store.read("kb_chunk")
    return documents.select(
        F.lit("document").alias("kind"), "id", "space_id", "title", "source_type", "status", "content").unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "id", "space_id", F.lit(None).cast("string").alias("title"),
                      F.lit(None).cast("string").alias("source_type"), "status", "content"))


@query
def chunk_status_commit(kb):
    """Chunks read back after the outcomes of vectorising were committed to the partitions that had pending chunks."""
    store = _versions(kb)
    feed.commit_outcomes(store, kb.fresh_vectors)
    return store.read("kb_chunk").select("id", "embedding_status", "vector_id", "status")


def _poor(kb):
    return kb.raw("labels").filter("quality = 0").select(F.col("doc_id").alias("id"))


@query
def soft_delete_cascade(kb):
    documents, chunks = ingest.soft_delete_documents(kb.documents, kb.chunks, _poor(kb))
    return documents.select(F.lit("document").alias("kind"), "id", "status").unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "id", "status"))


@query
def integrity_report(kb):
    gone = kb.spaces.withColumn("status", F.when(F.col("name") == "es", fv.DELETED).otherwise(F.col("status")))
    return integrity.integrity_report({
        "kb_space": gone, "kb_document": kb.documents,
        "kb_chunk": kb.chunks.withColumn("status", F.lit(fv.ACTIVE)),
        "qa_session": kb.sessions, "qa_message": kb.messages, "qa_reference": kb.references,
        "eval_dataset": kb.datasets, "eval_case": kb.cases})


# --- listings -------------------------------------------------------------------------------------------------

@query
def active_spaces(kb):
    return listing.spaces(kb.spaces)


@query
def active_documents(kb):
    return listing.documents(kb.documents).select("id", "space_id", "title", "source_type", "status")


@query
def active_documents_of_space(kb):
    return listing.documents(kb.documents, space_id=2).select("id", "space_id", "title")


@query
def document_chunks(kb):
    return listing.document_chunks(kb.chunks, kb.documents).select(
        "id", "document_id", "chunk_index", "content", "char_count", "embedding_status")


def _tasks(kb):
    counts = vectorize.rollup(kb.chunks, kb.documents, kb.fresh_vectors)
    return vectorize.finish_tasks(vectorize.new_tasks(kb.documents), counts)


@query
def tasks_by_document(kb):
    return listing.document_tasks(_tasks(kb).withColumn("id", F.col("document_id") * 2))


@query
def sessions_by_space(kb):
    return listing.sessions(kb.sessions).select(
        "id", "space_id", "title", _text("created_at"), _text("updated_at"))


@query
def session_messages(kb):
    return listing.messages(kb.messages, kb.sessions).select(
        "id", "session_id", "space_id", "role", "content", _text("created_at"))


@query
def message_references(kb):
    return listing.references(kb.references, kb.messages).select(
        "id", "message_id", "session_id", "reference_index", "chunk_id", "document_id", "space_id", "chunk_index",
        scores.rounded(F.col("score")).alias("score"), "content_preview")


def _written(kb, rows, name):
    root = shared_folder(kb.spark, "listed")
    write_table(rows, root, name)
    return read_table(kb.spark, root, name)


def _users(kb):
    """Ids of the users of events, as ids of sessions or documents that are asked for; not all exist."""
    return kb.raw("events").select(F.col("user_id").alias("id"))


@query
def messages_of_sessions(kb):
    return listing.messages_of(_written(kb, kb.messages, "qa_message"), kb.sessions, _users(kb)).select(
        "id", "session_id", "space_id", "role", "content", _text("created_at"))


@query
def unknown_sessions(kb):
    return listing.unknown(kb.sessions, _users(kb), "session not found")


@query
def references_of_messages(kb):
    """References of the last message of every session."""
    last = kb.messages.groupBy("session_id").agg(F.max("id").alias("id"))
    return listing.references_of(_written(kb, kb.references, "qa_reference"), kb.messages, last).select(
        "id", "message_id", "reference_index", "chunk_id", "document_id", "space_id", "content_preview")


@query
def chunks_of_documents(kb):
    return listing.chunks_of(_written(kb, kb.chunks, "kb_chunk"), kb.documents, _users(kb)).select(
        "id", "document_id", "space_id", "chunk_index", "content", "embedding_status")


@query
def eval_datasets(kb):
    return listing.eval_datasets(kb.datasets).select("id", "space_id", "name", _text("created_at"))


@query
def eval_cases(kb):
    expected = kb.expected.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("expected_count"))
    listed = listing.eval_cases(kb.cases.join(expected, "id", "left"), kb.datasets)
    return listed.select("id", "dataset_id", "question", "expected_answer", "difficulty",
                         F.coalesce("expected_count", F.lit(0)).alias("expected_count"))


@query
def run_results(kb):
    results = _case_results(kb).withColumn("id", F.col("case_id") * 100 + F.col("run_id"))
    return listing.run_results(results, kb.runs).select(
        "id", "run_id", "case_id", "question", "answer",
        _joined("retrieved_chunk_ids").alias("retrieved_chunk_ids"), "expected_count", "grounded")


# --- storage --------------------------------------------------------------------------------------------------

@query
def stored_chunks(kb):
    """The chunk table written by space and read back."""
    root = shared_folder(kb.spark, "tables")
    write_table(kb.chunks, root, "kb_chunk")
    return read_table(kb.spark, root, "kb_chunk").select(
        "id", "document_id", "space_id", "chunk_index", "content", "char_count", "embedding_status", "vector_id",
        "status")


# --- vectorising ----------------------------------------------------------------------------------------------

@query
def pending_chunks(kb):
    return vectorize.pending_chunks(kb.chunks, kb.documents).select("id", "document_id", "chunk_index", "content")


@query
def vector_ids(kb):
    return kb.chunks.select("id", codes.vector_id(F.col("id")).alias("vector_id"))


@query
def vector_rows(kb):
    return vectorize.vector_rows(kb.chunks.filter(F.col("embedding_status") == fv.EMBEDDING_DONE))


@query
def attached_vectors(kb):
    pending = vectorize.pending_chunks(kb.chunks, kb.documents)
    return vectorize.attach_vectors(pending, kb.fresh_vectors).select(
        "id", F.coalesce(F.size("embedding"), F.lit(0)).alias("width"))


def _count_vector(texts):
    """A stand-in for an embedding model: text length and number of blanks; fails on texts shorter than 40."""
    sizes = pc.utf8_length(texts)
    pairs = zip(sizes.to_pylist(), pc.count_substring(texts, " ").to_pylist())
    return pa.array([None if size < 40 else [size, blanks] for size, blanks in pairs], pa.list_(pa.float32()))


@query
def embedded_batches(kb):
    return vectorize.embed_batches(vectorize.pending_chunks(kb.chunks, kb.documents), _count_vector).select(
        "id", F.get("embedding", F.lit(0)).cast("int").alias("size"),
        F.get("embedding", F.lit(1)).cast("int").alias("blanks"))


@query
def chunk_status_transition(kb):
    return vectorize.mark_outcomes(kb.chunks, kb.documents, kb.fresh_vectors).select(
        "id", "embedding_status", "vector_id", "status")


@query
def vectorize_rollup(kb):
    return vectorize.rollup(kb.chunks, kb.documents, kb.fresh_vectors)


@query
def task_status(kb):
    return _tasks(kb)


@query
def task_created(kb):
    return vectorize.new_tasks(kb.documents)


@query
def status_texts(kb):
    status = (F.col("doc_id") % 7).cast("int")
    return kb.raw("documents").select("doc_id", codes.status_text(status).alias("status_text"))


@query
def error_texts(kb):
    message = F.when(F.length("text") < 60, " \n").otherwise(F.col("text"))
    return kb.raw("conversations").select("conv_id", "turn", tx.error_text(message).alias("error_message"))


def _vectors_after_rebuild(kb):
    """Chunks of documents whose text a user changed are gone; their vectors are not."""
    changed = kb.raw("conversations").select(F.col("conv_id").alias("document_id")).distinct()
    return kb.chunks.join(changed, "document_id", "left_anti")


@query
def orphan_vectors(kb):
    return vectorize.orphan_vectors(kb.vectors, _vectors_after_rebuild(kb)).select("chunk_id", "vector_id")


@query
def compacted_vectors(kb):
    return vectorize.compact_vectors(kb.vectors, _vectors_after_rebuild(kb)).select("chunk_id", "vector_id")


# --- retrieval ------------------------------------------------------------------------------------------------

_RESULT = ["query_id", "rank", "chunk_id", "document_id", "space_id", "chunk_index", "content", "score",
           "vector_score", "keyword_score", "hybrid_score", "rerank_score", "final_score", "retrieval_source"]


def _search(kb, queries, **options):
    kb.pin_chunks()
    return retrieve.search(queries, kb.chunks, kb.vectors, kb.documents, kb.spaces, retrieve.Options(**options)).select(*_RESULT)


@query
def resolved_query_params(kb):
    return retrieve.judge(kb.mixed_queries, kb.spaces).select(
        "query_id", "mode", "top_k", "candidate_k", scores.rounded(F.col("vector_share")).alias("vector_share"),
        scores.rounded(F.col("keyword_share")).alias("keyword_share"), "vector_k", "fetch_k", "error")


@query
def rejected_queries(kb):
    """Queries in a deleted space, without a space, or blank."""
    spaces = kb.spaces.withColumn("status", F.when(F.col("name") == "fr", fv.DELETED).otherwise(F.col("status")))
    spoilt = kb.mixed_queries.withColumns({
        "space_id": F.when(F.col("item_id") % 9 != 0, F.col("space_id")),
        "query": F.when(F.length("query") > 30, F.col("query")).otherwise(" 　")})
    return retrieve.rejected(spoilt, spaces)


@query
def query_terms(kb):
    return kb.raw("benchmark").select(
        "item_id", F.posexplode(tx.query_terms(F.col("text"))).alias("position", "term"))


@query
def vector_topk(kb):
    return _search(kb, kb.queries("VECTOR_ONLY"))


@query
def vector_candidates(kb):
    kb.pin_chunks()
    valid, bounds = retrieve.prepare(kb.queries("HYBRID"), kb.spaces)
    return retrieve.vector_candidates(valid, kb.chunks, kb.vectors, kb.documents, bounds)


@query
def keyword_candidates(kb):
    valid, bounds = retrieve.prepare(kb.queries("KEYWORD_ONLY"), kb.spaces)
    return retrieve.keyword_candidates(valid, kb.chunks, bounds)


@query
def keyword_scores(kb):
    kb.pin_chunks()
    valid, bounds = retrieve.prepare(kb.queries("KEYWORD_ONLY", candidate_k=60), kb.spaces)
    found = retrieve.with_chunk(retrieve.keyword_candidates(valid, kb.chunks, bounds), kb.chunks, bounds)
    return found.join(valid.select("query_id", "terms"), "query_id").select(
        "query_id", "chunk_id", scores.keyword_score(F.col("terms"), F.col("content")).alias("keyword_score"))


@query
def keyword_topk(kb):
    return _search(kb, kb.queries("KEYWORD_ONLY"))


def _indexed(kb, queries):
    """Search with the keyword recall read from stored grams."""
    # The chunks are read for the store alone, so there is no second copy of them.
    store = _committed(kb)
    gram_index.build(store)
    chunks = store.read("kb_chunk")
    valid, bounds = retrieve.prepare(queries, kb.spaces)
    recall = gram_index.recall(store, retrieve.searchable, spaces=lambda rows: retrieve.of_spaces(rows, bounds))
    return retrieve.search_valid(valid, chunks, kb.vectors, kb.documents, bounds, retrieve.Options(recall=recall)).select(*_RESULT)


@query
def keyword_topk_indexed(kb):
    return _indexed(kb, kb.queries("KEYWORD_ONLY"))


@query
def keyword_topk_ci_ai(kb):
    """Queries written without accents find texts that have them."""
    plain = kb.queries("KEYWORD_ONLY").withColumn("query", tx.folded(F.col("query")))
    return _search(kb, plain, match="ci_ai")


@query
def keyword_topk_by_score(kb):
    """Keyword search whose recall keeps the best scored chunks."""
    return _search(kb, kb.queries("KEYWORD_ONLY"), candidate_order="score")


@query
def vector_topk_prefiltered(kb):
    """Only vectors of active chunks of active documents are fetched."""
    return _search(kb, kb.queries("VECTOR_ONLY"), prefilter_active=True)


@query
def hybrid_topk(kb):
    return _search(kb, kb.queries("HYBRID"))


@query
def symbol_terms(kb):
    terms = F.explode(F.array_distinct(tx.query_terms(F.col("text")))).alias("term")
    return kb.raw("conversations").select(terms).distinct().select(
        "term", tx.is_symbol_like(F.col("term")).alias("symbol_like"))


@query
def rerank_components(kb):
    kb.pin_chunks()
    valid, bounds = retrieve.prepare(kb.queries("HYBRID_RERANK"), kb.spaces)
    found = retrieve.with_chunk(
        retrieve.candidates(valid, kb.chunks, kb.vectors, kb.documents, bounds), kb.chunks, bounds)
    return retrieve.score_candidates(found, valid).select(
        "query_id", "chunk_id", "hybrid_score", "exact_score", "symbol_score", "rerank_score")


@query
def hybrid_rerank_topk(kb):
    return _search(kb, kb.queries("HYBRID_RERANK"))


@query
def mixed_mode_search(kb):
    return _search(kb, kb.mixed_queries)


# --- answers --------------------------------------------------------------------------------------------------

def _asks(kb):
    """Mixed queries as asks; some ask for more references than allowed."""
    return kb.mixed_queries.withColumns({
        "question": F.col("query"), "top_k": (F.col("item_id") % 16).cast("int")}).drop("query")


@query
def ask_params(kb):
    spoilt = _asks(kb).withColumns({
        "space_id": F.when(F.col("item_id") % 9 != 0, F.col("space_id")),
        "question": F.when(F.length("question") > 30, F.col("question")).otherwise(" ")})
    return answer.search_requests(spoilt).select("query_id", "space_id", "query", "retrieval_mode", "top_k").unionByName(
        answer.rejected_asks(spoilt).withColumnRenamed("error", "retrieval_mode"), allowMissingColumns=True)


def _asked(kb):
    asks = _asks(kb)
    return asks, _search(kb, answer.search_requests(asks))


@query
def rag_prompts(kb):
    asks, hits = _asked(kb)
    return answer.prompts(asks.select("query_id", "question"), hits)


@query
def answer_references(kb):
    _, hits = _asked(kb)
    return answer.references(hits)


def _answers(hits):
    return hits.filter("rank = 1").select("query_id", F.col("content").alias("answer"))


@query
def generated_answers(kb):
    """Answers of a caller's function; the stand-in tells the prompt's length."""
    asks, hits = _asked(kb)
    prompts = answer.prompts(asks.select("query_id", "question"), hits)
    return answer.generate_answers(prompts, pc.utf8_length)


@query
def no_hit_answers(kb):
    asks = kb.queries("KEYWORD_ONLY").withColumnRenamed("query", "question")
    hits = _search(kb, answer.search_requests(asks))
    return answer.responses(asks.select("query_id", "question"), hits, _answers(hits)).select(
        "query_id", "question", "answer", "reference_count",
        F.concat_ws(",", F.transform("references", lambda one: one["chunk_id"].cast("string"))).alias("chunk_ids"))


# --- history --------------------------------------------------------------------------------------------------

@query
def session_titles(kb):
    return kb.raw("conversations").select("conv_id", "turn", tx.session_title(F.col("text")).alias("title"))


def _session_asks(kb):
    """User turns as asks: the first turn opens a session; later ones name one, not always of their own space."""
    return kb.raw("conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        ((F.col("conv_id") + F.when(F.col("turn") > 3, 1).otherwise(0)) % 4 + 1).alias("space_id"),
        F.when(F.col("turn") > 0, F.col("conv_id")).alias("session_id"), F.col("text").alias("question"))


@query
def session_resolution(kb):
    return history.resolve_sessions(_session_asks(kb), kb.sessions).select(
        "query_id", "session_id", "space_id", "is_new_session", "title", "session_error")


def _answered(kb):
    """User turns with the assistant's next turn as the answer (none if there is none)."""
    talk = kb.raw("conversations")
    said = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return talk.filter("role = 'user'").join(said, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("session_id"),
        (F.col("conv_id") % 4 + 1).alias("space_id"), F.col("text").alias("question"), "answer")


@query
def ask_messages(kb):
    return history.answered_messages(_answered(kb))


@query
def reference_rows(kb):
    """Nested references back to rows; the second reference of each message comes without its index."""
    index = F.when(F.col("reference_index") != 2, F.col("reference_index"))
    entry = F.struct(
        F.col("reference_index").alias("place"), index.alias("reference_index"), "chunk_id", "document_id",
        "space_id", "chunk_index", "score", "content_preview")
    nested = kb.references.groupBy(F.col("message_id").alias("query_id"), "session_id").agg(
        F.sort_array(F.collect_list(entry)).alias("references"))
    return history.reference_rows(nested).withColumn("score", scores.rounded(F.col("score")))


@query
def session_touch(kb):
    asks = kb.messages.filter("role = 'user'").select(
        "session_id", (F.col("created_at") + F.expr("interval 1 hour")).alias("asked_at"))
    return history.touch_sessions(kb.sessions, asks).select("id", _text("updated_at"))


@query
def session_history_flat(kb):
    listed = history.session_history(kb.sessions, kb.messages, kb.references)
    return listed.select(
        "session_id", "session_title", "message_id", "role", "content", _text("created_at"),
        F.when(F.col("references").isNotNull(), F.concat_ws(",", F.transform(
            "references", lambda one: one["chunk_id"].cast("string")))).alias("chunk_ids"))


def _saved(kb):
    """User turns asked again, a day after the last message, with the references of the turns that answered them.

    The first turns open sessions; later ones name one, not always of their own space. The last turn may lack an answer.
    """
    answered_at = F.col("query_id") + 1
    asks = _session_asks(kb).withColumn("asked_at", at_second(answered_at + 100_000_000))
    cited = kb.references.groupBy((F.col("message_id") - 1).alias("query_id")).agg(F.sort_array(F.collect_list(F.struct(
        "reference_index", "chunk_id", "document_id", "space_id", "chunk_index", "score", "content_preview"))).alias("references"))
    answers = _answered(kb).filter(F.col("answer").isNotNull() | (F.col("query_id") % 2 == 0)).select("query_id", "answer")
    return history.save(asks, answers.join(cited, "query_id", "left"), kb.sessions, kb.messages, kb.references)


@query
def saved_history(kb):
    """New messages with their ids and times."""
    return _saved(kb).messages.select("id", "session_id", "space_id", "role", "content", _text("created_at"))


@query
def saved_references(kb):
    return _saved(kb).references.select(
        "id", "message_id", "session_id", "reference_index", "chunk_id", "document_id", "space_id", "chunk_index",
        scores.rounded(F.col("score")).alias("score"), "content_preview", _text("created_at"))


@query
def saved_sessions(kb):
    """All sessions after the batch: old ones touched, new ones titled."""
    return _saved(kb).sessions.select("id", "space_id", "title", "status", _text("created_at"), _text("updated_at"))


@query
def saved_asks(kb):
    """Ids of the saved asks, and the reasons of the rejected ones."""
    saved = _saved(kb)
    return saved.results.unionByName(saved.rejects, allowMissingColumns=True)


# --- evaluation -----------------------------------------------------------------------------------------------

def _latency():
    return F.col("case_id") % 50 + F.col("run_id") % 10 * 10


def _case_results(kb):
    """All runs; cases whose query has no visible text, or whose run names a deleted space, become error rows."""
    kb.pin_chunks()
    return evaluate.evaluate(
        kb.runs, kb.datasets, kb.cases, kb.expected, kb.chunks, kb.vectors, kb.documents, kb.spaces,
        answer=evaluate.best_chunk_answer(), latency=_latency())


@query
def run_config(kb):
    """Run requests told by the documents: mode, limits and flags are partly missing."""
    doc = F.col("doc_id")
    requests = kb.raw("documents").select(
        doc.alias("id"), space_of(F.col("lang")).alias("dataset_id"),
        F.when(doc % 3 == 0, F.col("source")).when(doc % 3 == 1, " ").alias("run_name"),
        F.when(doc % 4 == 0, "hybrid").when(doc % 4 == 1, "").when(doc % 4 == 2, " odd ").alias("retrieval_mode"),
        F.when(doc % 5 != 0, (doc % 7 - 1).cast("int")).alias("top_k"),
        F.when(doc % 6 != 0, (doc % 9 * 5).cast("int")).alias("candidate_k"),
        F.lit(0.6).alias("vector_weight"), F.lit(0.4).alias("keyword_weight"),
        F.when(doc % 3 != 0, doc % 2 == 0).alias("enable_answer_generation"))
    return evaluate.configure_runs(requests, F.concat(F.lit("eval-run-"), F.col("id").cast("string")))


@query
def case_json_roundtrip(kb):
    """Term lists written as JSON and read back; some are null, some malformed."""
    words = kb.items.select("item_id", F.when(F.col("item_id") % 4 != 3, F.col("keywords")).alias("words"))
    json = evaluate.write_list(F.col("words"))
    spoilt = F.when(F.col("item_id") % 5 == 4, F.concat(json, F.lit("oops"))).otherwise(json)
    return words.select(
        "item_id", json.alias("json"), F.concat_ws("|", evaluate.read_list(json, "string")).alias("words"),
        F.size(evaluate.read_list(F.substring(spoilt, 2, 100000), "string")).alias("size_of_malformed"),
        F.size(evaluate.read_list(F.lit(" "), "long")).alias("size_of_blank"))


@query
def case_metrics(kb):
    return _case_results(kb).select(
        "run_id", "case_id", _joined("retrieved_chunk_ids").alias("retrieved_chunk_ids"), "expected_count",
        "recall_at_k", "hit_at_k", "mrr", "answer_keyword_hit", "citation_correct", "grounded", "latency_ms",
        "error_message")


@query
def failed_case_metrics(kb):
    """The Spanish space is deleted: its vector and hybrid runs fail, its keyword run does not."""
    kb.pin_chunks()
    spaces = kb.spaces.withColumn("status", F.when(F.col("name") == "es", fv.DELETED).otherwise(F.col("status")))
    results = evaluate.evaluate(
        kb.runs, kb.datasets, kb.cases, kb.expected, kb.chunks, kb.vectors, kb.documents, spaces, latency=_latency())
    return evaluate.summarise_runs(results)


@query
def list_metrics(kb):
    """Metrics on id lists: a message's cited chunks against the chunks its session cites most."""
    cited = kb.references.groupBy("message_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("reference_index", "chunk_id"))),
                    lambda one: one["chunk_id"]).alias("retrieved"))
    expected = F.array(-F.col("message_id") - 1, F.get("retrieved", F.lit(2)), F.get("retrieved", F.lit(1)),
                       F.get("retrieved", F.lit(1)))
    lists = kb.messages.filter("role = 'assistant'").select(F.col("id").alias("message_id")).join(
        cited, "message_id", "left").withColumn("expected", F.array_compact(expected))
    return lists.select(
        "message_id",
        scores.rounded(evaluate.recall_at_k(F.col("expected"), F.col("retrieved"))).alias("recall_at_k"),
        evaluate.hit_at_k(F.col("expected"), F.col("retrieved")).alias("hit_at_k"),
        scores.rounded(evaluate.reciprocal_rank(F.col("expected"), F.col("retrieved"))).alias("mrr"))


def _summaries(kb):
    summary = kb.runs.join(
        evaluate.summarise_runs(_case_results(kb)).withColumnRenamed("run_id", "id"), "id").select(
        "id", "dataset_id", "run_name", "retrieval_mode", "total_case_count", "success_case_count",
        "failed_case_count", "avg_recall_at_k", "hit_rate_at_k", "mrr", "avg_answer_keyword_hit",
        "citation_correct_rate", "avg_latency_ms", "status")
    return pin(summary, "run-summaries")


@query
def run_summary(kb):
    return evaluate.summarise_runs(_case_results(kb))


def _comparisons(kb):
    """Per dataset its four runs, the second one twice; and three that are invalid."""
    first = F.col("id") * 10

    def ids(*offsets):
        return F.array(*[(first + n).cast("long") if n is not None else F.lit(None).cast("long") for n in offsets])

    def some(kind, run_ids):
        return kb.datasets.select((F.col("id") * 10 + kind).alias("comparison_id"), run_ids.alias("run_ids"))

    return (some(0, ids(1, 2, 3, 2, 4)).unionByName(some(1, ids(4, 4, 1))).unionByName(some(2, ids(1)))
            .unionByName(some(3, ids(1, None))).unionByName(some(4, ids(1, 9))))


@query
def run_comparison(kb):
    return evaluate.compare_runs(_comparisons(kb), _summaries(kb)).select(
        "comparison_id", "baseline_run_id", "order_index", "run_id", "dataset_id", "run_name", "retrieval_mode",
        "status", "total_case_count", "avg_recall_at_k", "hit_rate_at_k", "mrr", "avg_latency_ms",
        "delta_avg_recall_at_k", "delta_hit_rate_at_k", "delta_mrr", "delta_avg_latency_ms")


def _best(kb):
    return evaluate.best_runs(evaluate.compare_runs(_comparisons(kb), _summaries(kb)))


def _stored_results(kb):
    """Results of all runs after those of the odd ones were stored: only pairs of the others are searched."""
    kb.pin_chunks()
    store = eval_store.EvaluationStore(kb.spark, shared_folder(kb.spark, "evaluations"))
    content = (kb.datasets, kb.cases, kb.expected, kb.chunks, kb.vectors, kb.documents, kb.spaces)
    told = {"answer": evaluate.best_chunk_answer(), "latency": _latency()}
    eval_store.evaluate_stored(store, "tables-1", kb.runs.filter("id % 2 = 1"), *content, **told)
    return eval_store.evaluate_stored(store, "tables-1", kb.runs, *content, **told)


@query
def stored_case_metrics(kb):
    return _stored_results(kb).select(
        "run_id", "case_id", _joined("retrieved_chunk_ids").alias("retrieved_chunk_ids"), "expected_count",
        "recall_at_k", "hit_at_k", "mrr", "answer_keyword_hit", "citation_correct", "grounded", "latency_ms",
        "error_message")


@query
def stored_run_summary(kb):
    return evaluate.summarise_runs(_stored_results(kb))


@query
def best_runs(kb):
    return _best(kb)


@query
def comparison_summary(kb):
    return evaluate.comparison_summary(_best(kb)).select("comparison_id", "summary")


@query
def run_rejects(kb):
    """Runs of unknown data sets, of a deleted one, and of one whose cases are deleted."""
    runs = kb.runs.withColumn("dataset_id", F.col("dataset_id") + F.when(F.col("id") % 3 == 0, 100).otherwise(0))
    datasets = kb.datasets.withColumn("status", F.when(F.col("id") == 3, fv.DELETED).otherwise(F.col("status")))
    cases = kb.cases.withColumn("status", F.when(F.col("dataset_id") == 4, fv.DELETED).otherwise(F.col("status")))
    return evaluate.run_rejects(runs, datasets, cases)


@query
def compare_validation(kb):
    return evaluate.comparison_errors(_comparisons(kb), kb.runs)


@query
def case_quality(kb):
    """Datasets are the languages but Spanish is deleted; questions are conversation turns, some blank."""
    datasets = kb.datasets.withColumn("status", F.when(F.col("id") == 3, fv.DELETED).otherwise(F.col("status")))
    cases = kb.messages.select(
        "id", F.col("space_id").alias("dataset_id"),
        F.when(F.length("content") > 100, F.col("content")).otherwise(" \n").alias("question"))
    return evaluate.case_errors(cases, datasets)


@query
def dataset_quality(kb):
    rows = kb.named_spaces.select(
        "id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("space_id"),
        F.when(F.col("id") % 5 != 0, F.col("name")).otherwise(" ").alias("name"))
    return evaluate.dataset_errors(rows)


# --- streaming ------------------------------------------------------------------------------------------------

@query
def batch_task_rollup(kb):
    return vectorize.finished(rollup.outcome_counts(kb.outcomes))


def _stream(kb, table):
    """A given table as a file stream; a pattern of one name, since the table may be one file or a folder of files."""
    return kb.spark.readStream.schema(kb.raw(table).schema).parquet(f"{kb.sf_dir}/{table}.[p]arquet")


@query
def stream_task_rollup(kb):
    """The same counts from the events as a stream."""
    out = shared_folder(kb.spark, "task-rollup")
    outcomes = kb.outcomes_of(_stream(kb, "events"))
    rollup.start_rollup(outcomes, out, shared_folder(kb.spark, "task-rollup-state")).awaitTermination()
    return rollup.current_tasks(kb.spark, out)


def _events_in_files(kb, count):
    """The events in a folder of files, the latest first."""
    files = shared_folder(kb.spark, "event-files")
    kb.raw("events").repartitionByRange(count, F.desc("ts")).write.parquet(files)
    return files


@query
def stream_task_rollup_merged(kb):
    """The same counts from the events in a dozen batches, which are merged after every fourth."""
    files, out = _events_in_files(kb, 12), shared_folder(kb.spark, "merged-rollup")
    stream = kb.spark.readStream.schema(kb.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(files)
    rollup.start_rollup(kb.outcomes_of(stream), out, shared_folder(kb.spark, "merged-rollup-state"), compact_every=4).awaitTermination()
    return rollup.current_tasks(kb.spark, out)


@query
def stream_keyed_changes(kb):
    """The events in several batches, the latest first, and all sent again; the keys are held in RocksDB."""
    files = _events_in_files(kb, 3)
    kb.raw("events").repartitionByRange(3, F.desc("ts")).write.mode("append").parquet(files)
    stream = kb.spark.readStream.schema(kb.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(files)
    out = shared_folder(kb.spark, "keyed-changes")
    stream_ingest.start_keyed_changes(stream.select("event_id", "user_id", "event_type"), ["event_id"], out,
                                      shared_folder(kb.spark, "keyed-changes-state")).awaitTermination()
    return kb.spark.read.parquet(out).drop("batch_id")


@query
def stream_document_chunks(kb):
    """Chunks of the documents as a stream of versions."""
    versions = _stream(kb, "documents").select(
        F.col("doc_id").alias("id"), space_of(F.col("lang")).alias("space_id"), F.col("text").alias("content"),
        F.lit(1).cast("long").alias("version"))
    out = shared_folder(kb.spark, "stream-chunks")
    stream_ingest.start_ingest(versions, out, shared_folder(kb.spark, "stream-chunks-state")).awaitTermination()
    return stream_ingest.current_chunks(kb.spark, out).select(
        "document_id", "space_id", "chunk_index", "content", "char_count")


def _once(kb, stream):
    out = shared_folder(kb.spark, "stream-changes")
    stream_ingest.start_changes(stream.select("event_id", "user_id", "event_type"), ["event_id"], out,
                                shared_folder(kb.spark, "stream-changes-state")).awaitTermination()
    return kb.spark.read.parquet(out).drop("batch_id")


@query
def stream_repeated_changes(kb):
    """The events sent twice, each kept once."""
    return _once(kb, _stream(kb, "events").unionByName(_stream(kb, "events")))


@query
def stream_late_changes(kb):
    """The events in several batches, the latest first, and all sent again: none is too late."""
    files = shared_folder(kb.spark, "late-events")
    events = kb.raw("events")
    for _ in range(2):
        events.repartitionByRange(4, F.desc("ts")).write.mode("append").parquet(files)
    stream = kb.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    return _once(kb, stream)


QUERIES = {name: _over_test_data(build) for name, build in BUILDERS.items()}
