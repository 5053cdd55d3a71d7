"""The SQL each named query is checked against, for DuckDB over the same test tables.

Common tables are written once as CTEs; a query's statement takes those it refers to, directly or not.
"""

import re

from kbspark import fixed_values as fv

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_VISIBLE = (r"[^\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]")
_SEPARATORS = fv.TERM_SEPARATORS


def _trim(text: str) -> str:
    return f"trim({text}, {_BLANKS})"


def _has_text(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '{_VISIBLE}'), false)"


def _cut(text: str, size: int) -> str:
    return (f"CASE WHEN {text} IS NULL THEN '' WHEN length({text}) > {size} "
            f"THEN substr({text}, 1, {size}) || '...' ELSE {text} END")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _space(lang: str) -> str:
    return f"CASE {lang} WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END::BIGINT"


def _terms(text: str) -> str:
    parts = (f"list_filter(list_transform(regexp_split_to_array({_trim(text)}, '{_SEPARATORS}'), "
             f"lambda t: {_trim('t')}), lambda t: length(t) BETWEEN 1 AND {fv.TERM_MAX_LENGTH})")
    return (f"CASE WHEN {_trim(text)} = '' THEN CAST([] AS VARCHAR[]) WHEN len({parts}) = 0 THEN [{_trim(text)}] "
            f"ELSE {parts} END")


def _title(text: str) -> str:
    return f"CASE WHEN coalesce({_trim(text)}, '') = '' THEN '{fv.UNTITLED}' ELSE substr({_trim(text)}, 1, 50) END"


def _preview(text: str) -> str:
    flat = _trim(f"replace(replace({text}, chr(13), ' '), chr(10), ' ')")
    return _cut(f"({flat})", fv.PREVIEW_LENGTH)


def _status_text(code: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{name}'" for n, name in fv.STATUS_TEXT.items())
    return f"CASE {code} {cases} ELSE 'unknown' END"


def _vector_id(chunk_id: str) -> str:
    digest = f"md5('{fv.VECTOR_ID_PREFIX}' || {chunk_id})"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-3' || substr({digest}, 14, 3) || '-' || "
            f"{variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))")


def _symbol_like(term: str) -> str:
    marks = " OR ".join(f"contains({term}, '{mark}')" for mark in fv.SYMBOL_CHARACTERS)
    ends = " OR ".join(f"suffix({term}, '{end}')" for end in fv.SYMBOL_SUFFIXES)
    return f"(regexp_full_match({term}, '.*[A-Z].*[a-z].*') OR {marks} OR {ends})"


def _keyword_score(terms: str, content: str) -> str:
    hits = (f"list_transform({terms}, lambda t: (length(lower({content})) - "
            f"length(replace(lower({content}), lower(t), ''))) // length(t))")
    return (f"round(least(1e0, len(list_filter({hits}, lambda h: h > 0))::DOUBLE / len({terms}) "
            f"+ least({fv.HIT_BONUS_MAX}e0, list_sum({hits}) * {fv.HIT_BONUS}e0)), 6)")


_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds"

CTES: dict[str, str] = {}


def _chunks(source: str) -> str:
    """Pieces of a table's text, numbered after empty ones are dropped."""
    lap, size = fv.CHUNK_OVERLAP, fv.CHUNK_MAX_SIZE
    step = size - lap
    return f"""
SELECT id AS document_id, space_id, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INTEGER AS chunk_index,
       piece AS content
FROM (SELECT id, space_id, n, {_trim(f'substr(body, n * {step} + 1, {size})')} AS piece
      FROM (SELECT id, space_id, body,
                   unnest(range(0, 1 + greatest(0, ceil((length(body) - {size}) / {step}))::BIGINT)) AS n
            FROM (SELECT id, space_id,
                         {_trim("replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS body
                  FROM {source}) WHERE body <> ''))
WHERE piece <> ''"""


CTES["kb_space"] = f"""
SELECT {_space('lang')} AS id, lang AS name, 'documents in ' || lang AS description, 1 AS status
FROM (SELECT DISTINCT lang FROM documents)"""
CTES["request"] = f"""
SELECT doc_id AS id, {_space('lang')} AS space_id, substr(text, 1, 50) AS title, text AS content,
       CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE upper(source) END AS source_type,
       'doc://' || doc_id AS source_uri FROM documents"""
CTES["kb_document"] = f"""
SELECT r.id, space_id, title, content,
       CASE WHEN {_trim('source_type')} = '' THEN '{fv.DEFAULT_SOURCE_TYPE}' ELSE source_type END AS source_type,
       source_uri, CASE WHEN t.doc_id IS NULL THEN 1 ELSE 0 END AS status
FROM request r LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = r.id"""
CTES["piece"] = _chunks("request")
CTES["kb_chunk"] = f"""
SELECT id, document_id, space_id, chunk_index, content, length(content)::INTEGER AS char_count, embedding_status,
       CASE WHEN embedding_status = 1 THEN {_vector_id('id')} END AS vector_id, status
FROM (SELECT p.document_id * 1000000 + p.chunk_index AS id, p.*, d.status,
             CASE WHEN (p.document_id * 1000000 + p.chunk_index) % 17 = 3 THEN 2
                  WHEN (p.document_id * 1000000 + p.chunk_index) % 13 = 5 THEN 0 ELSE 1 END AS embedding_status
      FROM piece p JOIN kb_document d ON d.id = p.document_id)"""
_VEC = "(c.document_id * 31 + c.chunk_index) % (SELECT count(*) FROM embeddings)"
CTES["chunk_vector"] = f"""
SELECT c.vector_id, c.id AS chunk_id, c.document_id, c.space_id, c.chunk_index, e.embedding::DOUBLE[] AS embedding
FROM kb_chunk c JOIN embeddings e ON e.vec_id = {_VEC} WHERE c.embedding_status = 1"""
CTES["fresh_vector"] = f"""
SELECT c.id, e.embedding FROM kb_chunk c JOIN embeddings e ON e.vec_id = {_VEC}
WHERE c.embedding_status = 0 AND e.label <> 0"""
CTES["item"] = f"""
SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN longest[1:3] ELSE longest[1:2] || terms[1:1] END AS keywords
FROM (SELECT item_id, text, terms,
             list_transform(list_sort(list_transform(list_distinct(terms), lambda t: {{'n': -length(t), 't': t}})),
                            lambda e: e.t) AS longest
      FROM (SELECT item_id, text, {_terms('text')} AS terms FROM benchmark))"""
CTES["asked"] = """
SELECT item_id * 10 + space_id AS query_id, item_id, space_id, array_to_string(keywords, ' ') AS query,
       e.embedding::DOUBLE[] AS query_vec
FROM (SELECT *, unnest([1, 2, 3, 4])::BIGINT AS space_id FROM item) JOIN embeddings e ON e.vec_id = item_id"""
CTES["q_mixed"] = """
SELECT *, CASE item_id % 5 WHEN 0 THEN 'vector_only' WHEN 1 THEN ' KEYWORD_ONLY ' WHEN 2 THEN 'HYBRID'
                           WHEN 3 THEN 'Hybrid_Rerank' ELSE 'unknown' END AS retrieval_mode,
       CASE WHEN item_id % 11 <> 0 THEN item_id % 8 - 1 END AS top_k, item_id % 7 * 6 AS candidate_k,
       (item_id % 4)::DOUBLE * 0.25e0 - 0.25e0 AS vector_weight, (item_id % 3)::DOUBLE * 0.3e0 AS keyword_weight
FROM asked"""


def _single_mode(mode: str, candidate_k: int = 20) -> str:
    return (f"SELECT *, '{mode}' AS retrieval_mode, 5 AS top_k, {candidate_k} AS candidate_k, "
            f"0.6e0 AS vector_weight, 0.4e0 AS keyword_weight FROM asked")


def _resolved(source: str) -> str:
    modes = ", ".join(f"'{mode}'" for mode in fv.MODES)
    mode = f"upper({_trim('retrieval_mode')})"
    return f"""
SELECT * EXCLUDE (vw, kw), CASE WHEN vw + kw > 0 THEN vw / (vw + kw) ELSE 0.7e0 END AS vector_share,
       CASE WHEN vw + kw > 0 THEN kw / (vw + kw) ELSE 0.3e0 END AS keyword_share,
       least(CASE WHEN mode = 'VECTOR_ONLY' THEN top_k ELSE candidate_k END, 20) AS vector_k,
       greatest(3 * least(CASE WHEN mode = 'VECTOR_ONLY' THEN top_k ELSE candidate_k END, 20), 10) AS fetch_k
FROM (SELECT * EXCLUDE (candidate_k), greatest(candidate_k, top_k) AS candidate_k
      FROM (SELECT * REPLACE (CASE WHEN top_k > 0 THEN top_k ELSE 5 END AS top_k,
                              CASE WHEN candidate_k > 0 THEN candidate_k ELSE 20 END AS candidate_k),
                   CASE WHEN {mode} IN ({modes}) THEN {mode} ELSE 'VECTOR_ONLY' END AS mode,
                   CASE WHEN vector_weight >= 0 THEN vector_weight ELSE 0.7e0 END AS vw,
                   CASE WHEN keyword_weight >= 0 THEN keyword_weight ELSE 0.3e0 END AS kw,
                   {_terms('query')} AS terms
            FROM {source}))"""


def _search(name: str, source: str, valid: str = "true", fold: str = "lower({})", live: bool = False,
            recall_order: str = "c.id") -> None:
    """The CTEs ``name_valid`` to ``name_hits`` of a search of the query table ``source``.

    ``fold`` makes texts and terms comparable; with ``live`` only vectors of active chunks and documents are fetched.
    """
    fetched = "JOIN live_chunk l ON l.id = v.chunk_id" if live else ""
    CTES[f"{name}_valid"] = f"SELECT * FROM ({_resolved(source)}) WHERE {valid}"
    CTES[f"{name}_near"] = f"""
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS store_rank
    FROM (SELECT q.query_id, q.fetch_k, q.vector_k, v.chunk_id, v.document_id,
                 round(list_cosine_similarity(q.query_vec, v.embedding), 6) AS vector_score
          FROM {name}_valid q JOIN chunk_vector v ON v.space_id = q.space_id {fetched} WHERE q.mode <> 'KEYWORD_ONLY'))
WHERE store_rank <= fetch_k"""
    CTES[f"{name}_vector"] = f"""
SELECT query_id, chunk_id, vector_score, vector_rank FROM (
    SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY store_rank) AS vector_rank
    FROM {name}_near n JOIN kb_chunk c ON c.id = n.chunk_id AND c.status = 1
    JOIN kb_document d ON d.id = c.document_id AND d.status = 1)
WHERE vector_rank <= vector_k"""
    CTES[f"{name}_keyword"] = f"""
SELECT query_id, chunk_id, keyword_rank FROM (
    SELECT q.query_id, q.candidate_k, c.id AS chunk_id,
           row_number() OVER (PARTITION BY q.query_id ORDER BY {recall_order}) AS keyword_rank
    FROM {name}_valid q
    JOIN kb_chunk c ON c.space_id = q.space_id AND c.status = 1 AND c.embedding_status = 1
    WHERE q.mode <> 'VECTOR_ONLY'
      AND len(list_filter(q.terms, lambda t: contains({fold.format('c.content')}, {fold.format('t')}))) > 0)
WHERE keyword_rank <= candidate_k"""
    found = "len(list_filter(q.terms, lambda t: contains(lower(c.content), lower(t))))::DOUBLE / len(q.terms)"
    symbols = f"list_filter(q.terms, lambda t: {_symbol_like('t')})"
    CTES[f"{name}_known"] = f"""
SELECT m.*, q.mode, q.top_k, q.vector_share, q.keyword_share, c.document_id, c.space_id, c.chunk_index, c.content,
       CASE WHEN keyword_rank IS NOT NULL THEN {_keyword_score('q.terms', 'c.content')} END AS keyword_score,
       round({found}, 6) AS exact_part,
       CASE WHEN len({symbols}) > 0 THEN
           round(len(list_filter({symbols}, lambda t: contains(c.content, t)))::DOUBLE / len({symbols}), 6)
       ELSE 0e0 END AS symbol_part
FROM (SELECT * FROM {name}_vector FULL JOIN {name}_keyword USING (query_id, chunk_id)) m
JOIN {name}_valid q USING (query_id) JOIN kb_chunk c ON c.id = m.chunk_id"""
    best = "max(CASE WHEN {0} > 0 THEN {0} END) OVER (PARTITION BY query_id)"
    part = "CASE WHEN {0} > 0 THEN {0} / coalesce({1}, 1e0) ELSE 0e0 END"
    CTES[f"{name}_scored"] = f"""
SELECT *, CASE mode WHEN 'HYBRID_RERANK' THEN rerank_score WHEN 'HYBRID' THEN hybrid_score
                    WHEN 'KEYWORD_ONLY' THEN keyword_score ELSE vector_score END AS final_score
FROM (SELECT *, CASE WHEN mode = 'HYBRID_RERANK' THEN
                    round({fv.RERANK_HYBRID}e0 * hybrid_score + {fv.RERANK_EXACT}e0 * exact_part
                          + {fv.RERANK_SYMBOL}e0 * symbol_part, 6) END AS rerank_score
      FROM (SELECT *, CASE WHEN mode IN ('HYBRID', 'HYBRID_RERANK') THEN round(
                          vector_share * {part.format('vector_score', 'best_vector')}
                          + keyword_share * {part.format('keyword_score', 'best_keyword')}, 6) END AS hybrid_score
            FROM (SELECT *, {best.format('vector_score')} AS best_vector, {best.format('keyword_score')} AS best_keyword
                  FROM {name}_known)))"""
    CTES[f"{name}_hits"] = f"""
SELECT query_id, rank, chunk_id, document_id, space_id, chunk_index, content, final_score AS score, vector_score,
       keyword_score, hybrid_score, rerank_score, final_score,
       CASE WHEN vector_rank IS NULL THEN 'KEYWORD' WHEN keyword_rank IS NULL THEN 'VECTOR' ELSE 'BOTH' END
       AS retrieval_source
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC NULLS LAST, vector_rank IS NULL,
                                    coalesce(vector_rank, keyword_rank)))::INTEGER AS rank
      FROM {name}_scored) WHERE rank <= top_k"""


for _name, _mode, _candidates in (("v", "VECTOR_ONLY", 20), ("k", "KEYWORD_ONLY", 20), ("h", "HYBRID", 20),
                                  ("r", "HYBRID_RERANK", 20), ("w", "KEYWORD_ONLY", 60)):
    CTES[f"q_{_name}"] = _single_mode(_mode, _candidates)
    _search(_name, f"q_{_name}")
CTES["live_chunk"] = "SELECT c.id FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id WHERE c.status = 1 AND d.status = 1"
_search("p", "q_v", live=True)
CTES["q_c"] = "SELECT * REPLACE (strip_accents(lower(query)) AS query) FROM q_k"
_search("c", "q_c", fold="strip_accents(lower({}))")
_search("b", "q_k", recall_order=f"{_keyword_score('q.terms', 'c.content')} DESC, c.id")
_search("x", "q_mixed")
CTES["q_ask"] = "SELECT * REPLACE (CASE WHEN item_id % 16 > 0 THEN least(item_id % 16, 10) ELSE 5 END AS top_k) FROM q_mixed"
_search("a", "q_ask")

# --- evaluation ---
CTES["eval_case"] = """
SELECT dataset_id * 100000 + item_id AS id, dataset_id, item_id, array_to_string(keywords, ' ') AS question,
       text AS expected_answer, keywords, CASE WHEN length(text) > 250 THEN 'hard' ELSE 'easy' END AS difficulty,
       CASE WHEN length(text) < 100 THEN 0 ELSE 1 END AS status, e.embedding::DOUBLE[] AS query_vec
FROM (SELECT *, unnest([1, 2, 3, 4])::BIGINT AS dataset_id FROM item) JOIN embeddings e ON e.vec_id = item_id"""
CTES["expected"] = """
SELECT k.id AS case_id, c.id AS chunk_id FROM eval_case k
JOIN kb_chunk c ON c.space_id = k.dataset_id AND c.status = 1 AND contains(c.content, k.expected_answer)"""
CTES["eval_run"] = """
SELECT dataset_id * 10 + n AS id, dataset_id, 'run-' || lower(mode) AS run_name, mode AS retrieval_mode, n
FROM (SELECT id AS dataset_id, unnest([1, 2, 3, 4])::BIGINT AS n,
             unnest(['VECTOR_ONLY', 'KEYWORD_ONLY', 'HYBRID', 'HYBRID_RERANK']) AS mode FROM kb_space)"""
CTES["q_eval"] = """
SELECT r.id || ':' || k.id AS query_id, r.id AS run_id, k.id AS case_id, k.dataset_id AS space_id,
       k.question AS query, k.query_vec, k.keywords, r.retrieval_mode, r.n >= 3 AS with_answer, 5 AS top_k,
       20 AS candidate_k, 0.6e0 AS vector_weight, 0.4e0 AS keyword_weight
FROM eval_run r JOIN eval_case k USING (dataset_id) WHERE k.status = 1"""
_search("e", "q_eval")
_search("f", "q_eval", "mode = 'KEYWORD_ONLY' OR space_id <> 3")


def _results(name: str, answers: bool, failed: str) -> str:
    answer = f"CASE WHEN with_answer AND NOT failed THEN coalesce(best_text, '{fv.NO_HIT_ANSWER}') END" if answers else "NULL"
    return f"""
SELECT *, round(coalesce(matched::DOUBLE / expected_size, 0e0), 6) AS recall_at_k, (matched > 0)::INTEGER AS hit_at_k,
       round(coalesce(1e0 / first_rank, 0e0), 6) AS mrr,
       CASE WHEN answer IS NULL THEN 0e0 ELSE round(len(list_filter(keywords,
           lambda t: contains(lower(answer), lower(t))))::DOUBLE / len(keywords), 6) END AS answer_keyword_hit
FROM (SELECT *, {answer} AS answer
      FROM (SELECT q.run_id, q.case_id, q.query AS question, q.keywords, q.with_answer,
                   ({failed}) AS failed, h.ids, coalesce(h.matched, 0) AS matched, h.first_rank, h.best_text,
                   s.expected_size, q.case_id % 50 + q.run_id % 10 * 10 AS latency_ms
            FROM ({_resolved('q_eval')}) q
            LEFT JOIN (SELECT x.query_id, string_agg(x.chunk_id::VARCHAR, ',' ORDER BY x.rank) AS ids,
                              count(w.chunk_id) AS matched, min(CASE WHEN w.chunk_id IS NOT NULL THEN x.rank END)
                              AS first_rank, max(CASE WHEN x.rank = 1 THEN x.content END) AS best_text
                       FROM {name}_hits x JOIN q_eval q USING (query_id)
                       LEFT JOIN (SELECT DISTINCT * FROM expected) w
                              ON w.case_id = q.case_id AND w.chunk_id = x.chunk_id
                       GROUP BY x.query_id) h USING (query_id)
            LEFT JOIN (SELECT case_id, count(DISTINCT chunk_id) AS expected_size FROM expected GROUP BY case_id) s
                   USING (case_id)))"""


CTES["result"] = _results("e", True, "false")
CTES["failed_result"] = _results("f", False, "NOT (mode = 'KEYWORD_ONLY' OR space_id <> 3)")


def _summary(source: str) -> str:
    def mean(name: str) -> str:
        return f"round(coalesce(avg({name}::DOUBLE) FILTER (WHERE NOT failed), 0e0), 6)"

    return f"""
SELECT run_id, total_case_count, success_case_count, total_case_count - success_case_count AS failed_case_count,
       avg_recall_at_k, hit_rate_at_k, mrr, avg_answer_keyword_hit, hit_rate_at_k AS citation_correct_rate,
       avg_latency_ms, CASE WHEN success_case_count = total_case_count THEN 2 WHEN success_case_count > 0 THEN 4
                            ELSE 3 END AS status
FROM (SELECT run_id, count(*) AS total_case_count, count(*) FILTER (WHERE NOT failed) AS success_case_count,
             {mean('recall_at_k')} AS avg_recall_at_k, {mean('hit_at_k')} AS hit_rate_at_k, {mean('mrr')} AS mrr,
             {mean('answer_keyword_hit')} AS avg_answer_keyword_hit, {mean('latency_ms')} AS avg_latency_ms
      FROM {source} GROUP BY run_id)"""


CTES["summary"] = _summary("result")
CTES["comparison"] = """
SELECT id * 10 + kind AS comparison_id, list_transform(CASE kind WHEN 0 THEN [1, 2, 3, 2, 4] WHEN 1 THEN [4, 4, 1]
       WHEN 2 THEN [1] WHEN 3 THEN [1, NULL] ELSE [1, 9] END, lambda n: id * 10 + n) AS run_ids, kind
FROM (SELECT id, unnest([0, 1, 2, 3, 4])::BIGINT AS kind FROM kb_space)"""
CTES["compared"] = """
SELECT comparison_id, run_id, (row_number() OVER (PARTITION BY comparison_id ORDER BY place))::INTEGER AS order_index,
       first_value(run_id) OVER (PARTITION BY comparison_id ORDER BY place) AS baseline_run_id
FROM (SELECT comparison_id, run_id, min(place) AS place
      FROM (SELECT comparison_id, unnest(run_ids) AS run_id, generate_subscripts(run_ids, 1) AS place FROM comparison
            WHERE kind < 2) GROUP BY comparison_id, run_id)"""
CTES["compared_item"] = """
SELECT c.*, r.dataset_id, r.run_name, r.retrieval_mode, s.* EXCLUDE (run_id),
       round(s.avg_recall_at_k - b.avg_recall_at_k, 6) AS delta_avg_recall_at_k,
       round(s.hit_rate_at_k - b.hit_rate_at_k, 6) AS delta_hit_rate_at_k, round(s.mrr - b.mrr, 6) AS delta_mrr,
       round(s.avg_latency_ms - b.avg_latency_ms, 6) AS delta_avg_latency_ms
FROM compared c JOIN eval_run r ON r.id = c.run_id JOIN summary s USING (run_id)
JOIN summary b ON b.run_id = c.baseline_run_id"""
CTES["best"] = """
SELECT comparison_id, any_value(baseline_run_id) AS baseline_run_id, count(*)::INTEGER AS compared_run_count,
       first(run_id ORDER BY avg_recall_at_k DESC, order_index) AS best_recall_run_id,
       first(run_id ORDER BY hit_rate_at_k DESC, order_index) AS best_hit_rate_run_id,
       first(run_id ORDER BY mrr DESC, order_index) AS best_mrr_run_id,
       first(run_id ORDER BY avg_latency_ms, order_index) AS fastest_run_id
FROM compared_item GROUP BY comparison_id"""

# --- vectorising ---
CTES["counts"] = """
SELECT d.id AS document_id, count(c.id)::INTEGER AS total_chunk_count,
       count(c.id) FILTER (WHERE c.embedding_status = 0)::INTEGER AS pending_chunk_count,
       count(f.id)::INTEGER AS success_count,
       (count(c.id) FILTER (WHERE c.embedding_status = 0) - count(f.id))::INTEGER AS failed_count,
       count(c.id) FILTER (WHERE c.embedding_status <> 0)::INTEGER AS skipped_count
FROM kb_document d LEFT JOIN kb_chunk c ON c.document_id = d.id AND c.status = 1
LEFT JOIN fresh_vector f ON f.id = c.id WHERE d.status = 1 GROUP BY d.id"""


def _task_status(source: str) -> str:
    return f"""
SELECT *, {_status_text('status')} AS status_text
FROM (SELECT *, CASE WHEN total_chunk_count = 0 THEN 3 WHEN failed_count = 0 THEN 2
                     WHEN success_count > 0 OR skipped_count > 0 THEN 4 ELSE 3 END AS status,
             CASE WHEN total_chunk_count = 0 THEN '{fv.NO_CHUNKS_MESSAGE}' WHEN failed_count = 0 THEN NULL
                  WHEN success_count > 0 OR skipped_count > 0 THEN '{fv.SOME_FAILED_MESSAGE}'
                  ELSE '{fv.ALL_FAILED_MESSAGE}' END AS error_message
      FROM {source})"""


_NAMES = ("total_chunk_count", "pending_chunk_count", "success_count", "failed_count", "skipped_count")
_ZEROS = ", ".join(f"coalesce({name}, 0)::INTEGER AS {name}" for name in _NAMES)
CTES["task"] = f"""
SELECT d.id AS document_id, d.space_id, '{fv.TASK_TYPE}' AS task_type, {_ZEROS},
       coalesce(s.status, 3) AS status, {_status_text('coalesce(s.status, 3)')} AS status_text,
       CASE WHEN s.document_id IS NULL THEN 'document not found' ELSE s.error_message END AS error_message
FROM kb_document d LEFT JOIN ({_task_status('counts')}) s ON s.document_id = d.id"""
CTES["live_after_rebuild"] = """
SELECT * FROM kb_chunk WHERE status = 1 AND document_id NOT IN (SELECT conv_id FROM conversations)"""

# --- history ---
CTES["qa_message"] = f"""
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 4 + 1 AS space_id, role, text AS content,
       {_AT}(conv_id * 1000 + turn) AS created_at FROM conversations"""
CTES["qa_session"] = f"""
SELECT conv_id AS id, conv_id % 4 + 1 AS space_id, {_title('text')} AS title,
       CASE WHEN role = 'system' THEN 0 ELSE 1 END AS status, {_AT}(conv_id) AS created_at,
       {_AT}(conv_id * 1000 + last_turn) AS updated_at
FROM conversations JOIN (SELECT conv_id, min(turn) AS turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
USING (conv_id, turn)"""
CTES["qa_reference"] = f"""
SELECT m.id * 10 + c.chunk_index + 1 AS id, m.id AS message_id, m.session_id, c.chunk_index + 1 AS reference_index,
       c.id AS chunk_id, c.document_id, c.space_id, c.chunk_index, round(1e0 / (c.chunk_index + 1), 6) AS score,
       {_preview('c.content')} AS content_preview, m.created_at
FROM qa_message m
JOIN kb_chunk c ON c.document_id = m.session_id % (SELECT count(*) FROM documents) AND c.chunk_index < 3
WHERE m.role = 'assistant' AND m.id % 4 <> 3"""

CTES["saved_judged"] = f"""
SELECT a.*, r.answer_id, r.answer, n.n_refs, CASE WHEN NOT {_has_text('a.question')} THEN 'question blank'
       WHEN r.answer IS NULL AND a.query_id % 2 <> 0 THEN 'answer missing'
       WHEN a.session_id IS NOT NULL AND coalesce(s.status, 0) <> 1 THEN 'session not found'
       WHEN a.session_id IS NOT NULL AND s.space_id <> a.space_id THEN 'session of another space' END AS error
FROM (SELECT conv_id * 1000 + turn AS query_id, (conv_id + CASE WHEN turn > 3 THEN 1 ELSE 0 END) % 4 + 1 AS space_id,
             CASE WHEN turn > 0 THEN conv_id END AS session_id, text AS question,
             {_AT}(conv_id * 1000 + turn + 1 + 100000000) AS asked_at FROM conversations WHERE role = 'user') a
LEFT JOIN (SELECT conv_id * 1000 + turn - 1 AS query_id, conv_id * 1000 + turn AS answer_id, text AS answer
           FROM conversations WHERE role = 'assistant') r USING (query_id)
LEFT JOIN (SELECT message_id - 1 AS query_id, count(*) AS n_refs FROM qa_reference GROUP BY message_id) n USING (query_id)
LEFT JOIN qa_session s ON s.id = a.session_id"""
_BEFORE = "OVER (ORDER BY md5(query_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"
CTES["saved_ask"] = f"""
SELECT *, (SELECT max(id) FROM qa_message) + 1 + coalesce(sum(2) {_BEFORE} AS user_id,
       (SELECT max(id) FROM qa_reference) + 1 + coalesce(sum(coalesce(n_refs, 0)) {_BEFORE} AS first_ref,
       coalesce(session_id, (SELECT max(id) FROM qa_session) + 1 + coalesce(sum((session_id IS NULL)::INTEGER) {_BEFORE})
       AS saved_session
FROM saved_judged WHERE error IS NULL"""

# --- change feeds ---
CTES["change"] = """
SELECT turn * 1000000 + conv_id AS seq, CASE WHEN role = 'system' THEN 'delete' ELSE 'update' END AS op,
       conv_id * 3 AS id, CASE WHEN turn % 2 = 1 THEN conv_id % 5 + 1 END AS space_id, substr(text, 1, 40) AS title,
       text AS content, CASE WHEN turn > 1 THEN 'CHAT' || turn END AS source_type, 'chat://' || conv_id AS source_uri
FROM conversations
UNION ALL
SELECT 9000000000 + conv_id, CASE conv_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'create' WHEN 2 THEN 'upsert' END,
       CASE WHEN conv_id % 4 <> 3 THEN conv_id * 3 END, 1, CASE conv_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN repeat('t', 400)
       ELSE 'title' END, CASE conv_id % 4 WHEN 0 THEN chr(10) ELSE text END, '', 'chat://' || conv_id
FROM conversations WHERE turn = 1"""
CTES["judged_change"] = f"""
SELECT c.*, CASE WHEN coalesce(c.op, '') NOT IN ('create', 'update', 'delete') THEN 'unknown operation'
                 WHEN c.id IS NULL THEN 'id missing'
                 WHEN c.op <> 'delete' AND coalesce({_trim('c.title')}, '') = '' THEN 'title blank'
                 WHEN c.op <> 'delete' AND coalesce({_trim('c.content')}, '') = '' THEN 'content blank'
                 WHEN c.op <> 'delete' AND length(c.title) > 255 THEN 'title longer than 255'
                 WHEN c.op = 'update' AND c.space_id IS NOT NULL AND c.space_id NOT IN (SELECT id FROM kb_space)
                 THEN 'space not found' WHEN coalesce(d.status, 0) <> 1 THEN 'document not found'
                 WHEN c.seq > min(c.seq) FILTER (WHERE c.op = 'delete') OVER (PARTITION BY c.id)
                 THEN 'document not found' END AS reason
FROM change c LEFT JOIN kb_document d ON d.id = c.id"""
CTES["written"] = """
SELECT id, last(title ORDER BY seq) AS title, last(content ORDER BY seq) AS content,
       last(source_uri ORDER BY seq) AS source_uri,
       last(space_id ORDER BY seq) FILTER (WHERE space_id IS NOT NULL) AS space_id,
       last(source_type ORDER BY seq) FILTER (WHERE source_type IS NOT NULL) AS source_type
FROM judged_change WHERE reason IS NULL AND op = 'update' GROUP BY id"""
CTES["dead"] = "SELECT DISTINCT id FROM judged_change WHERE reason IS NULL AND op = 'delete'"
CTES["document_after"] = """
SELECT d.id, coalesce(w.space_id, d.space_id) AS space_id, coalesce(w.title, d.title) AS title,
       coalesce(w.content, d.content) AS content, coalesce(w.source_type, d.source_type) AS source_type,
       coalesce(w.source_uri, d.source_uri) AS source_uri,
       CASE WHEN d.id IN (SELECT id FROM dead) THEN 0 ELSE d.status END AS status
FROM kb_document d LEFT JOIN written w USING (id)"""
CTES["rewritten"] = "SELECT * FROM document_after WHERE id IN (SELECT id FROM written)"
CTES["new_piece"] = _chunks("rewritten")
CTES["named_space"] = f"""
SELECT {_space('lang')} * 100 + substr(source, 4)::BIGINT AS id, source AS name, 'documents in ' || lang AS description,
       CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS status FROM (SELECT DISTINCT lang, source FROM documents)"""
CTES["space_request"] = """
SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE upper(name) END AS name, 'renamed ' || name AS description
FROM named_space"""
CTES["space_conflict"] = """
SELECT r.id, r.name, CASE WHEN EXISTS (SELECT 1 FROM named_space s WHERE s.status = 1 AND s.name = r.name
                                       AND s.id <> r.id)
                          THEN 'name of an active space' ELSE 'name of an earlier request' END AS reason
FROM space_request r
WHERE EXISTS (SELECT 1 FROM named_space s WHERE s.status = 1 AND s.name = r.name AND s.id <> r.id)
   OR EXISTS (SELECT 1 FROM space_request o WHERE o.name = r.name AND o.id < r.id)"""
CTES["space_dead"] = "SELECT id FROM named_space WHERE status = 0"
CTES["space_taken"] = """
SELECT r.id, r.name, CASE WHEN EXISTS (SELECT 1 FROM named_space s WHERE s.status = 1 AND s.name = r.name
                                       AND s.id <> r.id)
                          THEN 'name of an active space' ELSE 'name of an earlier request' END AS reason
FROM space_request r
WHERE id NOT IN (SELECT id FROM space_dead)
  AND (EXISTS (SELECT 1 FROM named_space s WHERE s.status = 1 AND s.name = r.name AND s.id <> r.id)
       OR EXISTS (SELECT 1 FROM space_request o WHERE o.name = r.name AND o.id < r.id
                  AND o.id NOT IN (SELECT id FROM space_dead)))"""
CTES["source_document"] = """
SELECT CASE WHEN lang = 'en' THEN 2 ELSE 4 END * 100 + substr(source, 4)::BIGINT AS space_id,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0 ELSE 1 END AS status FROM documents"""
CTES["deletable"] = """
SELECT id, name FROM named_space WHERE id NOT IN (SELECT space_id FROM source_document WHERE status = 1)"""
CTES["edited"] = f"""
SELECT id, CASE WHEN length(content) > 3000 THEN substr(content, 1, 300)
                WHEN length(content) < 200 THEN ' ' ELSE title END AS title, content,
       source_type || substr(content, 1, 60) AS source_type,
       CASE WHEN source_type <> 'SRC3' THEN space_id END AS space_id, source_uri
FROM request"""


def _rules() -> dict[str, str]:
    rules = {"space_id missing": "space_id IS NULL", "title blank": f"{_trim('title')} = ''",
             "content blank": f"{_trim('content')} = ''"}
    for name, size in fv.DOCUMENT_LIMITS.items():
        rules[f"{name} longer than {size}"] = f"length({name}) > {size}"
    return rules


# --- streaming ---
CTES["outcome"] = """
SELECT user_id AS document_id, CASE WHEN event_type = 'error' THEN 'failed'
       WHEN event_type IN ('view', 'click') THEN 'skipped' ELSE 'success' END AS outcome FROM events"""
CTES["outcome_count"] = """
SELECT document_id, count(*) AS total_chunk_count, count(*) FILTER (WHERE outcome <> 'skipped') AS pending_chunk_count,
       count(*) FILTER (WHERE outcome = 'success') AS success_count,
       count(*) FILTER (WHERE outcome = 'failed') AS failed_count,
       count(*) FILTER (WHERE outcome = 'skipped') AS skipped_count FROM outcome GROUP BY document_id"""


def statement(select: str) -> str:
    """The statement with the CTEs it needs, in order of definition."""
    needed, todo = set(), [select]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    tables = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {tables}\n{select}" if tables else select


_SPOILT_SPACE = "CASE WHEN item_id % 9 <> 0 THEN space_id END"
_PROMPT_BLOCK = (
    "chr(10) || '[Reference ' || rank || ']' || chr(10) || 'Document ID: ' || document_id || chr(10) || 'Chunk ID: ' "
    "|| chunk_id || chr(10) || 'Chunk Index: ' || chunk_index || chr(10) || 'Content:' || chr(10) || "
    f"{_cut('content', fv.CONTEXT_LENGTH)} || chr(10)")
_ERROR = f"CASE WHEN length(text) < 60 THEN ' ' ELSE text END"
_EDGES = [
    ("kb_document", "space_id", "(SELECT id FROM kb_space WHERE name <> 'es')", "status = 1", "space not found"),
    ("kb_chunk", "document_id", "(SELECT id FROM kb_document WHERE status = 1)", "true", "document not found"),
    ("qa_session", "space_id", "(SELECT id FROM kb_space WHERE name <> 'es')", "status = 1", "space not found"),
    ("eval_dataset", "space_id", "(SELECT id FROM kb_space WHERE name <> 'es')", "true", "space not found"),
    ("qa_message", "session_id", "(SELECT id FROM qa_session)", "true", "session not found"),
    ("qa_reference", "message_id", "(SELECT id FROM qa_message)", "true", "message not found"),
]
CTES["eval_dataset"] = f"""
SELECT id, id AS space_id, 'dataset-' || name AS name, {_AT}(id) AS created_at FROM kb_space"""
_CHUNK_COLUMNS = ("id, document_id, space_id, chunk_index, content, char_count, embedding_status, vector_id")
_HITS = "SELECT * FROM {}_hits"

_SELECTS = {
    "chunk_documents": "SELECT document_id, space_id, chunk_index, content, length(content)::INTEGER AS char_count FROM piece",
    "document_chunk_counts": "SELECT r.id, count(p.document_id)::INTEGER AS chunk_count FROM request r "
                             "LEFT JOIN piece p ON p.document_id = r.id GROUP BY r.id",
    "default_source_type": "SELECT id, title, source_type, 1 AS status FROM kb_document",
    "document_quality_violations": " UNION ALL ".join(
        f"SELECT id, '{rule}' AS rule FROM edited WHERE {broken}" for rule, broken in _rules().items()),
    "conforming_documents": "SELECT id, title FROM edited WHERE NOT coalesce("
                            + " OR ".join(f"coalesce({broken}, false)" for broken in _rules().values()) + ", false)",
    "space_name_conflicts": "SELECT * FROM space_conflict",
    "space_upsert": "SELECT s.id, coalesce(r.name, s.name) AS name, coalesce(r.description, s.description) AS "
                    "description, s.status FROM named_space s LEFT JOIN (SELECT * FROM space_request WHERE id NOT IN "
                    "(SELECT id FROM space_dead) AND id NOT IN (SELECT id FROM space_taken)) r USING (id)",
    "space_request_rejects": "SELECT id, name, 'space not found' AS reason FROM space_request WHERE id IN "
                             "(SELECT id FROM space_dead) UNION ALL SELECT id, name, reason FROM space_taken",
    "space_delete_rejects": "SELECT id, 'space has active documents' AS reason FROM named_space WHERE id NOT IN "
                            "(SELECT id FROM deletable) UNION ALL SELECT id + 1000000, 'space not found' FROM named_space",
    "deletable_spaces": "SELECT * FROM deletable",
    "space_soft_delete": "SELECT id, CASE WHEN id IN (SELECT id FROM deletable) THEN 0 ELSE 1 END AS status "
                         "FROM named_space",
    "document_update_rebuild": f"""
SELECT {_CHUNK_COLUMNS}, CASE WHEN document_id IN (SELECT id FROM dead) THEN 0 ELSE status END AS status FROM (
    SELECT {_CHUNK_COLUMNS}, status FROM kb_chunk WHERE document_id NOT IN (SELECT id FROM written)
    UNION ALL SELECT coalesce(free_id, document_id * 1000000) + chunk_index, document_id, space_id, chunk_index, content,
                     length(content)::INTEGER, 0, NULL, 1 FROM new_piece
    LEFT JOIN (SELECT document_id, max(id) + 1 AS free_id FROM kb_chunk GROUP BY document_id) USING (document_id))""",
    "document_update_rows": "SELECT id, space_id, title, source_type, source_uri, status FROM document_after",
    "document_update_rejects": "SELECT seq, op, id, reason FROM judged_change WHERE reason IS NOT NULL",
    "document_feed_commit": f"""
SELECT 'document' AS kind, id, space_id, title, source_type, status, content FROM document_after UNION ALL
SELECT 'chunk', id, space_id, NULL, NULL, CASE WHEN document_id IN (SELECT id FROM dead) THEN 0 ELSE status END, content FROM (
    SELECT id, document_id, space_id, content, status FROM kb_chunk WHERE document_id NOT IN (SELECT id FROM written)
    UNION ALL SELECT coalesce(free_id, document_id * 1000000) + chunk_index, document_id, space_id, content, 1 FROM new_piece
    LEFT JOIN (SELECT document_id, max(id) + 1 AS free_id FROM kb_chunk GROUP BY document_id) USING (document_id))""",
    "soft_delete_cascade": """
SELECT 'document' AS kind, id, CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0 ELSE status END
AS status FROM kb_document UNION ALL
SELECT 'chunk', id, CASE WHEN document_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0 ELSE status END
FROM kb_chunk""",
    "integrity_report": " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{child}' AS table_name, id FROM {child} WHERE {when} AND {key} NOT IN {parents}"
        for child, key, parents, when, rule in _EDGES),

    "active_spaces": "SELECT id, name, description, status FROM kb_space",
    "active_documents": "SELECT id, space_id, title, source_type, status FROM kb_document WHERE status = 1",
    "active_documents_of_space": "SELECT id, space_id, title FROM kb_document WHERE status = 1 AND space_id = 2",
    "document_chunks": "SELECT id, document_id, chunk_index, content, char_count, embedding_status FROM kb_chunk "
                       "WHERE status = 1",
    "tasks_by_document": "SELECT *, document_id * 2 AS id FROM task",
    "sessions_by_space": "SELECT id, space_id, title, created_at::VARCHAR AS created_at, updated_at::VARCHAR AS "
                         "updated_at FROM qa_session WHERE status = 1",
    "session_messages": "SELECT id, session_id, space_id, role, content, created_at::VARCHAR AS created_at "
                        "FROM qa_message WHERE session_id IN (SELECT id FROM qa_session WHERE status = 1)",
    "message_references": "SELECT * EXCLUDE (created_at) FROM qa_reference",
    "messages_of_sessions": "SELECT id, session_id, space_id, role, content, created_at::VARCHAR AS created_at FROM "
                            "qa_message WHERE session_id IN (SELECT user_id FROM events) AND session_id IN "
                            "(SELECT id FROM qa_session WHERE status = 1)",
    "unknown_sessions": "SELECT DISTINCT user_id AS id, 'session not found' AS error FROM events WHERE user_id NOT IN "
                        "(SELECT id FROM qa_session WHERE status = 1)",
    "references_of_messages": "SELECT id, message_id, reference_index, chunk_id, document_id, space_id, content_preview "
                              "FROM qa_reference WHERE message_id IN (SELECT max(id) FROM qa_message GROUP BY session_id)",
    "chunks_of_documents": "SELECT id, document_id, space_id, chunk_index, content, embedding_status FROM kb_chunk WHERE "
                           "status = 1 AND document_id IN (SELECT user_id FROM events) AND document_id IN "
                           "(SELECT id FROM kb_document WHERE status = 1)",
    "eval_datasets": "SELECT id, space_id, name, created_at::VARCHAR AS created_at FROM eval_dataset",
    "eval_cases": "SELECT k.id, dataset_id, question, expected_answer, difficulty, "
                  "(SELECT count(*) FROM expected x WHERE x.case_id = k.id) AS expected_count "
                  "FROM eval_case k WHERE status = 1",
    "run_results": "SELECT case_id * 100 + run_id AS id, run_id, case_id, question, answer, coalesce(ids, '') AS "
                   "retrieved_chunk_ids, coalesce(expected_size, 0) AS expected_count, (ids IS NOT NULL)::INTEGER AS "
                   "grounded FROM result",

    "pending_chunks": "SELECT id, document_id, chunk_index, content FROM kb_chunk WHERE status = 1 "
                      "AND embedding_status = 0",
    "vector_ids": f"SELECT id, {_vector_id('id')} AS vector_id FROM kb_chunk",
    "vector_rows": f"SELECT vector_id, chunk_id, document_id, space_id, chunk_index, '{fv.VECTOR_SOURCE}' AS source "
                   "FROM chunk_vector",
    "attached_vectors": "SELECT c.id, coalesce(len(f.embedding), 0)::INTEGER AS width FROM kb_chunk c "
                        "LEFT JOIN fresh_vector f USING (id) WHERE c.status = 1 AND c.embedding_status = 0",
    "embedded_batches": "SELECT id, CASE WHEN length(content) >= 40 THEN length(content) END::INTEGER AS size, "
                        "CASE WHEN length(content) >= 40 THEN length(content) - length(replace(content, ' ', '')) END"
                        "::INTEGER AS blanks FROM kb_chunk WHERE status = 1 AND embedding_status = 0",
    "stored_chunks": f"SELECT {_CHUNK_COLUMNS}, status FROM kb_chunk",
    "chunk_status_transition": f"""
SELECT c.id, CASE WHEN c.status = 1 AND c.embedding_status = 0 THEN CASE WHEN f.id IS NULL THEN 2 ELSE 1 END
                  ELSE c.embedding_status END AS embedding_status,
       CASE WHEN c.status = 1 AND c.embedding_status = 0 AND f.id IS NOT NULL THEN {_vector_id('c.id')}
            ELSE c.vector_id END AS vector_id, c.status
FROM kb_chunk c LEFT JOIN fresh_vector f USING (id)""",
    "chunk_status_commit": f"""
SELECT c.id, CASE WHEN c.status = 1 AND c.embedding_status = 0 THEN CASE WHEN f.id IS NULL THEN 2 ELSE 1 END
                  ELSE c.embedding_status END AS embedding_status,
       CASE WHEN c.status = 1 AND c.embedding_status = 0 AND f.id IS NOT NULL THEN {_vector_id('c.id')}
            ELSE c.vector_id END AS vector_id, c.status
FROM kb_chunk c LEFT JOIN fresh_vector f USING (id)""",
    "vectorize_rollup": "SELECT * FROM counts",
    "task_status": "SELECT * FROM task",
    "task_created": f"SELECT id AS document_id, space_id, '{fv.TASK_TYPE}' AS task_type, 0 AS status, "
                    + ", ".join(f"0 AS {name}" for name in _NAMES) + ", NULL::VARCHAR AS error_message FROM kb_document",
    "status_texts": f"SELECT doc_id, {_status_text('doc_id % 7')} AS status_text FROM documents",
    "error_texts": f"SELECT conv_id, turn, CASE WHEN {_trim(_ERROR)} = '' THEN '{fv.UNKNOWN_ERROR}' ELSE "
                   f"substr({_ERROR}, 1, 1000) END AS error_message FROM conversations",
    "orphan_vectors": "SELECT chunk_id, vector_id FROM chunk_vector WHERE chunk_id NOT IN "
                      "(SELECT id FROM live_after_rebuild)",
    "compacted_vectors": "SELECT chunk_id, vector_id FROM chunk_vector WHERE chunk_id IN "
                         "(SELECT id FROM live_after_rebuild)",

    "resolved_query_params": "SELECT query_id, mode, top_k::INTEGER AS top_k, candidate_k::INTEGER AS candidate_k, "
                             "round(vector_share, 6) AS vector_share, round(keyword_share, 6) AS keyword_share, "
                             "vector_k::INTEGER AS vector_k, fetch_k::INTEGER AS fetch_k, NULL::VARCHAR AS error "
                             "FROM x_valid",
    "rejected_queries": f"""
SELECT query_id, error FROM (
    SELECT query_id, CASE WHEN space IS NULL THEN 'space_id missing' WHEN blank THEN 'query blank'
                          WHEN mode <> 'KEYWORD_ONLY' AND space = 4 THEN 'space not found' END AS error
    FROM (SELECT query_id, mode, {_SPOILT_SPACE} AS space, length(query) <= 30 AS blank FROM x_valid))
WHERE error IS NOT NULL""",
    "query_terms": f"""
SELECT item_id, (generate_subscripts(terms, 1) - 1)::INTEGER AS position, unnest(terms) AS term
FROM (SELECT item_id, {_terms('text')} AS terms FROM benchmark)""",
    "vector_topk": _HITS.format("v"),
    "vector_candidates": "SELECT query_id, chunk_id, vector_score, vector_rank::INTEGER AS vector_rank FROM h_vector",
    "keyword_candidates": "SELECT query_id, chunk_id, keyword_rank::INTEGER AS keyword_rank FROM k_keyword",
    "keyword_scores": "SELECT query_id, chunk_id, keyword_score FROM w_known",
    "keyword_topk": _HITS.format("k"),
    "keyword_topk_indexed": _HITS.format("k"),
    "keyword_topk_ci_ai": _HITS.format("c"),
    "keyword_topk_by_score": _HITS.format("b"),
    "vector_topk_prefiltered": _HITS.format("p"),
    "hybrid_topk": _HITS.format("h"),
    "symbol_terms": f"SELECT term, {_symbol_like('term')} AS symbol_like FROM (SELECT DISTINCT unnest("
                    f"{_terms('text')}) AS term FROM conversations)",
    "rerank_components": "SELECT query_id, chunk_id, hybrid_score, exact_part AS exact_score, symbol_part AS "
                         "symbol_score, rerank_score FROM r_scored",
    "hybrid_rerank_topk": _HITS.format("r"),
    "mixed_mode_search": _HITS.format("x"),

    "ask_params": f"""
SELECT query_id, space_id, query, retrieval_mode, top_k FROM (
    SELECT query_id, {_SPOILT_SPACE} AS space_id, query, retrieval_mode,
           CASE WHEN item_id % 16 > 0 THEN least(item_id % 16, 10) ELSE 5 END::INTEGER AS top_k FROM q_mixed
    WHERE length(query) > 30) WHERE space_id IS NOT NULL
UNION ALL SELECT query_id, NULL, NULL, CASE WHEN item_id % 9 = 0 THEN 'space_id missing' ELSE 'question blank' END, NULL
FROM q_mixed WHERE item_id % 9 = 0 OR length(query) <= 30""",
    "rag_prompts": f"""
SELECT q.query_id, q.query AS question, {_quoted(fv.PROMPT_HEADER)} || q.query || {_quoted(fv.PROMPT_CONTEXT)}
       || h.context || {_quoted(fv.PROMPT_FOOTER)} AS prompt
FROM q_ask q JOIN (SELECT query_id, string_agg({_PROMPT_BLOCK}, '' ORDER BY rank) AS context FROM a_hits
                   GROUP BY query_id) h USING (query_id)""",
    "generated_answers": f"""
SELECT query_id, length({_quoted(fv.PROMPT_HEADER)} || q.query || {_quoted(fv.PROMPT_CONTEXT)} || h.context
                        || {_quoted(fv.PROMPT_FOOTER)})::VARCHAR AS answer
FROM q_ask q JOIN (SELECT query_id, string_agg({_PROMPT_BLOCK}, '' ORDER BY rank) AS context FROM a_hits
                   GROUP BY query_id) h USING (query_id)""",
    "answer_references": f"SELECT query_id, rank AS reference_index, chunk_id, document_id, space_id, chunk_index, "
                         f"score, {_preview('content')} AS content_preview FROM a_hits",
    "no_hit_answers": f"""
SELECT q.query_id, q.query AS question, coalesce(h.answer, '{fv.NO_HIT_ANSWER}') AS answer,
       coalesce(h.n, 0)::INTEGER AS reference_count, coalesce(h.chunk_ids, '') AS chunk_ids
FROM q_k q LEFT JOIN (SELECT query_id, max(CASE WHEN rank = 1 THEN content END) AS answer, count(*) AS n,
                             string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids
                      FROM k_hits GROUP BY query_id) h USING (query_id)""",

    "session_titles": f"SELECT conv_id, turn, {_title('text')} AS title FROM conversations",
    "session_resolution": f"""
SELECT query_id, session_id, a.space_id, session_id IS NULL AS is_new_session,
       CASE WHEN session_id IS NULL THEN {_title('a.question')} END AS title,
       CASE WHEN session_id IS NULL THEN NULL WHEN coalesce(s.status, 0) <> 1 THEN 'session not found'
            WHEN s.space_id <> a.space_id THEN 'session of another space' END AS session_error
FROM (SELECT conv_id * 1000 + turn AS query_id, (conv_id + CASE WHEN turn > 3 THEN 1 ELSE 0 END) % 4 + 1 AS space_id,
             CASE WHEN turn > 0 THEN conv_id END AS session_id, text AS question
      FROM conversations WHERE role = 'user') a LEFT JOIN qa_session s ON s.id = a.session_id""",
    "ask_messages": """
SELECT u.conv_id * 1000 + u.turn AS query_id, u.conv_id AS session_id, u.conv_id % 4 + 1 AS space_id, p.position,
       CASE p.position WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
       CASE p.position WHEN 0 THEN u.text ELSE coalesce(a.text, '') END AS content
FROM conversations u JOIN (SELECT unnest([0, 1]) AS position) p ON true
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "reference_rows": "SELECT message_id AS query_id, session_id, reference_index, chunk_id, document_id, space_id, "
                      "chunk_index, score, content_preview FROM qa_reference",
    "session_touch": """
SELECT s.id, coalesce(m.latest + INTERVAL 1 HOUR, s.updated_at)::VARCHAR AS updated_at FROM qa_session s
LEFT JOIN (SELECT session_id, max(created_at) AS latest FROM qa_message WHERE role = 'user' GROUP BY session_id) m
       ON m.session_id = s.id""",
    "session_history_flat": """
SELECT m.session_id, s.title AS session_title, m.id AS message_id, m.role, m.content, m.created_at::VARCHAR AS created_at,
       CASE WHEN m.role = 'assistant' THEN coalesce(r.chunk_ids, '') END AS chunk_ids
FROM qa_message m JOIN qa_session s ON s.id = m.session_id AND s.status = 1
LEFT JOIN (SELECT message_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY reference_index) AS chunk_ids
           FROM qa_reference GROUP BY message_id) r ON r.message_id = m.id""",

    "saved_history": """
SELECT user_id AS id, saved_session AS session_id, space_id, 'user' AS role, question AS content,
       asked_at::VARCHAR AS created_at FROM saved_ask
UNION ALL
SELECT user_id + 1, saved_session, space_id, 'assistant', coalesce(answer, ''), asked_at::VARCHAR FROM saved_ask""",
    "saved_references": """
SELECT a.first_ref + r.reference_index - 1 AS id, a.user_id + 1 AS message_id, a.saved_session AS session_id,
       r.reference_index, r.chunk_id, r.document_id, r.space_id, r.chunk_index, r.score, r.content_preview,
       a.asked_at::VARCHAR AS created_at
FROM saved_ask a JOIN qa_reference r ON r.message_id - 1 = a.query_id""",
    "saved_sessions": f"""
SELECT s.id, s.space_id, s.title, s.status, s.created_at::VARCHAR AS created_at,
       coalesce(t.latest, s.updated_at)::VARCHAR AS updated_at
FROM qa_session s LEFT JOIN (SELECT session_id, max(asked_at) AS latest FROM saved_ask GROUP BY session_id) t
  ON t.session_id = s.id
UNION ALL
SELECT saved_session, space_id, {_title('question')}, 1, asked_at::VARCHAR, asked_at::VARCHAR FROM saved_ask
WHERE session_id IS NULL""",
    "saved_asks": """
SELECT query_id, saved_session AS session_id, user_id AS user_message_id, user_id + 1 AS assistant_message_id,
       NULL::VARCHAR AS error FROM saved_ask
UNION ALL
SELECT query_id, NULL, NULL, NULL, error FROM saved_judged WHERE error IS NOT NULL""",

    "run_config": f"""
SELECT doc_id AS id, {_space('lang')} AS dataset_id,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE 'eval-run-' || doc_id END AS run_name,
       CASE doc_id % 4 WHEN 0 THEN 'hybrid' WHEN 2 THEN ' odd ' ELSE 'VECTOR_ONLY' END AS retrieval_mode,
       CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 > 1 THEN doc_id % 7 - 1 ELSE 5 END::INTEGER AS top_k,
       CASE WHEN doc_id % 6 <> 0 AND doc_id % 9 > 0 THEN doc_id % 9 * 5 ELSE 20 END::INTEGER AS candidate_k,
       0.6e0 AS vector_weight, 0.4e0 AS keyword_weight,
       CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS enable_answer_generation, 0 AS status
FROM documents""",
    "case_json_roundtrip": """
SELECT item_id, CASE WHEN item_id % 4 <> 3 THEN to_json(keywords)::VARCHAR ELSE '[]' END AS json,
       CASE WHEN item_id % 4 <> 3 THEN array_to_string(keywords, '|') ELSE '' END AS words,
       0 AS size_of_malformed, 0 AS size_of_blank FROM item""",
    "case_metrics": "SELECT run_id, case_id, coalesce(ids, '') AS retrieved_chunk_ids, coalesce(expected_size, 0) AS "
                    "expected_count, recall_at_k, hit_at_k, mrr, answer_keyword_hit, hit_at_k AS citation_correct, "
                    "(ids IS NOT NULL)::INTEGER AS grounded, latency_ms, NULL::VARCHAR AS error_message FROM result",
    "failed_case_metrics": _summary("failed_result"),
    "stored_run_summary": "SELECT * FROM summary",
    "list_metrics": """
SELECT message_id, CASE WHEN len(ids) = 0 THEN 0e0 ELSE round(len(wanted)::DOUBLE / (len(wanted) + 1), 6) END
       AS recall_at_k, (len(wanted) > 0)::INTEGER AS hit_at_k,
       CASE WHEN len(wanted) > 0 THEN 0.5e0 ELSE 0e0 END AS mrr
FROM (SELECT message_id, ids, ids[2:3] AS wanted
      FROM (SELECT m.id AS message_id, coalesce(list(r.chunk_id ORDER BY r.reference_index)
                   FILTER (WHERE r.chunk_id IS NOT NULL), []) AS ids
            FROM qa_message m LEFT JOIN qa_reference r ON r.message_id = m.id WHERE m.role = 'assistant'
            GROUP BY m.id))""",
    "run_summary": "SELECT * FROM summary",
    "run_comparison": "SELECT comparison_id, baseline_run_id, order_index, run_id, dataset_id, run_name, "
                      "retrieval_mode, status, total_case_count, avg_recall_at_k, hit_rate_at_k, mrr, avg_latency_ms, "
                      "delta_avg_recall_at_k, delta_hit_rate_at_k, delta_mrr, delta_avg_latency_ms FROM compared_item",
    "best_runs": "SELECT * FROM best",
    "comparison_summary": f"""
SELECT comparison_id, '{fv.COMPARE_SUMMARY_HEAD[0]}' || compared_run_count || '{fv.COMPARE_SUMMARY_HEAD[1]}'
       || '{fv.COMPARE_SUMMARY_RECALL}' || best_recall_run_id || '{fv.COMPARE_SUMMARY_STOP}'
       || '{fv.COMPARE_SUMMARY_HIT}' || best_hit_rate_run_id || '{fv.COMPARE_SUMMARY_STOP}'
       || '{fv.COMPARE_SUMMARY_MRR}' || best_mrr_run_id || '{fv.COMPARE_SUMMARY_STOP}'
       || '{fv.COMPARE_SUMMARY_FASTEST}' || fastest_run_id || '{fv.COMPARE_SUMMARY_STOP}'
       || '{fv.COMPARE_SUMMARY_TAIL}' AS summary FROM best""",
    "run_rejects": f"""
SELECT * FROM (
    SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'dataset not found' WHEN dataset_id = 3 THEN 'dataset inactive'
                        WHEN dataset_id = 4 THEN 'no active case' END AS reason
    FROM (SELECT dataset_id, dataset_id * 10 + unnest([1, 2, 3, 4]) AS run_id
          FROM (SELECT DISTINCT {_space('lang')} AS dataset_id FROM documents)))
WHERE reason IS NOT NULL""",
    "compare_validation": "SELECT comparison_id, CASE kind WHEN 2 THEN 'fewer than two runs' WHEN 3 THEN "
                          "'run id missing' ELSE 'run not found' END AS error FROM comparison WHERE kind >= 2",
    "case_quality": "SELECT id, CASE WHEN space_id = 3 THEN 'dataset not found' ELSE 'question blank' END AS error "
                    "FROM qa_message WHERE space_id = 3 OR length(content) <= 100",
    "dataset_quality": "SELECT id, CASE WHEN id % 3 = 0 THEN 'space_id missing' ELSE 'name blank' END AS error "
                       "FROM named_space WHERE id % 3 = 0 OR id % 5 = 0",

    "batch_task_rollup": _task_status("outcome_count"),
    "stream_task_rollup": _task_status("outcome_count"),
    "stream_task_rollup_merged": _task_status("outcome_count"),
    "stream_document_chunks": "SELECT document_id, space_id, chunk_index, content, length(content)::INTEGER AS "
                              "char_count FROM piece",
    "stream_repeated_changes": "SELECT event_id, user_id, event_type FROM events",
    "stream_late_changes": "SELECT event_id, user_id, event_type FROM events",
    "stream_keyed_changes": "SELECT event_id, user_id, event_type FROM events",
}

_SELECTS["stored_case_metrics"] = _SELECTS["case_metrics"]

ORACLES = {name: statement(select) for name, select in _SELECTS.items()}
