"""Top-k search of a table of queries: vector, keyword, hybrid and hybrid with rule rerank, in one job."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import codes, scores, text as tx
from kbspark.operators.best_first import best_texts
from kbspark.operators.contains import contains_join
from kbspark.operators.limits import (GROUP_LIMIT_MAX, MAX_BROADCAST_ROWS, broadcast_if, in_slices, max_broadcast_bytes,
                                      pin)
from kbspark.operators.lookup import Slice, looked_up, slices
from kbspark.operators.nearest import nearest

# Bytes of a broadcast candidate row: ids, ranks, a score and the hash-table entry.
_CANDIDATE_BYTES = 160

# Bytes of a broadcast chunk id.
_ID_BYTES = 64

RESULT_COLUMNS = [
    "query_id", "rank", "chunk_id", "document_id", "space_id", "chunk_index", "content", "score", "vector_score",
    "keyword_score", "hybrid_score", "rerank_score", "final_score", "retrieval_source"]


class Bounds(NamedTuple):
    """Measured once per job; what may be broadcast follows from it."""
    queries: int
    candidate_k: int
    by_vector: int
    by_keyword: int
    spaces: list[int] | None


class Options(NamedTuple):
    """How candidates are found.

    ``match`` is ``ci`` (terms ignore case) or ``ci_ai`` (accents as well); scores ignore case only. ``recall`` finds
    the chunks of a table of terms in another way than by reading all texts, as ``gram_index.recall`` does, and decides
    itself how it matches. ``prefilter_active`` fetches vectors of active chunks of active documents only.
    ``candidate_order`` is ``chunk_id`` (keyword recall keeps the lowest chunk ids) or ``score`` (the best scores).
    """
    min_score: float | None = None
    match: str = "ci"
    recall: "Recall | None" = None
    prefilter_active: bool = False
    candidate_order: str = "chunk_id"


# Chunks ``(space_id, term, chunk_id)`` of distinct ``(space_id, term)``, as many as each term needs.
Recall = Callable[[DataFrame, int | None], DataFrame]

# More spaces than this are not listed in a scan's filter.
MAX_LISTED_SPACES = 1000


# --- requests -------------------------------------------------------------------------------------------------

def resolve(queries: DataFrame) -> DataFrame:
    """Defaults for missing parameters, the search terms, and what each mode needs."""
    k = F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(fv.DEFAULT_TOP_K)
    candidate = F.when(F.col("candidate_k") > 0, F.col("candidate_k")).otherwise(fv.DEFAULT_CANDIDATE_K)
    weights = {
        name: F.when(F.col(name) >= 0, F.col(name)).otherwise(default)
        for name, default in (("vector_weight", fv.DEFAULT_VECTOR_WEIGHT),
                              ("keyword_weight", fv.DEFAULT_KEYWORD_WEIGHT))}
    named = queries.withColumns({
        "mode": codes.retrieval_mode(F.col("retrieval_mode")), "top_k": k, "candidate_k": F.greatest(candidate, k),
        **weights})
    # Both weights zero: back to the defaults.
    total = F.col("vector_weight") + F.col("keyword_weight")

    def share(name: str, default: float) -> Column:
        return F.when(total > 0, F.col(name) / total).otherwise(default)

    vector_k = F.least(
        F.when(F.col("mode") == "VECTOR_ONLY", F.col("top_k")).otherwise(F.col("candidate_k")),
        F.lit(fv.VECTOR_TOP_K_MAX))
    return named.withColumns({
        "vector_share": share("vector_weight", fv.DEFAULT_VECTOR_WEIGHT),
        "keyword_share": share("keyword_weight", fv.DEFAULT_KEYWORD_WEIGHT),
        "vector_k": vector_k,
        "fetch_k": F.greatest(vector_k * fv.VECTOR_FETCH_FACTOR, F.lit(fv.VECTOR_FETCH_MIN)),
        "use_vector": F.col("mode") != "KEYWORD_ONLY",
        "use_keyword": F.col("mode") != "VECTOR_ONLY",
        "terms": tx.query_terms(F.col("query"))})


def judge(queries: DataFrame, spaces: DataFrame) -> DataFrame:
    """Resolved queries with ``error``: null where the query can run."""
    active = spaces.filter(F.col("status") == fv.ACTIVE).select(
        F.col("id").alias("space_id"), F.lit(True).alias("_active"))
    error = (F.when(F.col("space_id").isNull(), "space_id missing")
             .when(~tx.has_text(F.col("query")), "query blank")
             .when(F.col("use_vector") & F.col("_active").isNull(), "space not found"))
    return resolve(queries).join(active, "space_id", "left").withColumn("error", error).drop("_active")


def rejected(queries: DataFrame, spaces: DataFrame) -> DataFrame:
    return judge(queries, spaces).filter(F.col("error").isNotNull()).select("query_id", "error")


def measure(queries: DataFrame) -> Bounds:
    """Counts and limits of the queries, and their spaces if these are few."""
    counts = [F.count("*").alias("n"), F.max("candidate_k").alias("k"), F.count_if("use_vector").alias("v"),
              F.count_if("use_keyword").alias("w")]
    rows = queries.groupBy("space_id").agg(*counts).limit(MAX_LISTED_SPACES + 1).collect()
    spaces = sorted(row.space_id for row in rows) if len(rows) <= MAX_LISTED_SPACES else None
    if spaces is None:
        rows = queries.agg(*counts).collect()
    return Bounds(sum(row.n for row in rows), max((row.k for row in rows), default=0), sum(row.v for row in rows),
                  sum(row.w for row in rows), spaces)


def of_spaces(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows of the queried spaces: prunes the directories of tables that are partitioned by space.

    For vectors and for keyword recall, which belong to a space. Chunks of hits are looked up by id alone, so that what
    a query finds does not depend on the spaces of the other queries.
    """
    return rows if bounds.spaces is None else rows.filter(F.col("space_id").isin(bounds.spaces))


def prepare(queries: DataFrame, spaces: DataFrame) -> tuple[DataFrame, Bounds]:
    """The queries that can run, computed once, and their measure."""
    valid = pin(judge(queries, spaces).filter(F.col("error").isNull()).drop("error"), "queries")
    return valid, measure(valid)


# --- vector branch --------------------------------------------------------------------------------------------

def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(chunk_id)`` of active chunks of active documents; narrow columns only."""
    active = documents.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("document_id"))
    return chunks.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("chunk_id"), "document_id").join(
        active, "document_id", "left_semi").select("chunk_id")


def _nearest(probes: DataFrame, vectors: DataFrame, min_score: float | None, live: DataFrame | None) -> DataFrame:
    """Best hits of the probes, of vectors of ``live`` chunks only where these are given.

    The ids of vectors that do not count are found among ids alone. They are taken out of the scan as a broadcast; more
    than fit are cut into ranges of ids, and the best hits of all ranges are merged. Vectors are not shuffled.
    """
    if live is None:
        return nearest(probes, vectors, min_score)
    dead = pin(vectors.select("chunk_id").distinct().join(live, "chunk_id", "left_anti"), "vectors-left-out")
    fit = max(1, min(MAX_BROADCAST_ROWS, max_broadcast_bytes(dead.sparkSession) // _ID_BYTES))
    some = slices(dead, "chunk_id", fit) or [Slice(None, None, 0, 1)]

    def of_range(one: Slice) -> DataFrame:
        rest = vectors.filter(one.ids("chunk_id")).join(F.broadcast(one.rows(dead, "chunk_id")), "chunk_id", "left_anti")
        return nearest(probes, rest, min_score)

    if len(some) == 1:
        return of_range(some[0])
    schema = nearest(probes, vectors.limit(0), min_score).schema
    hits = in_slices([lambda one=one: of_range(one) for one in some], schema, probes.sparkSession, "range-hits")
    order = Window.partitionBy("probe_id").orderBy(F.desc("vector_score"), "chunk_id")
    best = hits.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= fv.VECTOR_FETCH_CAP)
    return best.join(probes.select("probe_id", "fetch_k"), "probe_id").filter(F.col("vector_rank") <= F.col("fetch_k")).drop("fetch_k")


def vector_candidates(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame,
                      bounds: Bounds, min_score: float | None = None, prefilter_active: bool = False) -> DataFrame:
    """``(query_id, chunk_id, vector_score, vector_rank)`` of resolved queries.

    The fetch counts stored vectors of any status; inactive chunks and documents are dropped afterwards, so fewer
    than ``vector_k`` rows may remain. With ``prefilter_active`` only vectors of active chunks of active documents are
    fetched. Queries with the same ``probe_id`` share space and vector and are scored once.
    """
    wanted = queries.filter("use_vector")
    vectors = of_spaces(vectors, bounds)
    live = live_chunks(chunks, documents) if prefilter_active else None
    if "probe_id" in queries.columns:
        probes = wanted.groupBy("probe_id").agg(
            F.any_value("space_id").alias("space_id"), F.max("fetch_k").alias("fetch_k"),
            F.any_value("query_vec").alias("query_vec"))
        hits = (_nearest(probes, vectors, min_score, live)
                .join(wanted.select("probe_id", "query_id", "fetch_k", "vector_k"), "probe_id")
                .filter(F.col("vector_rank") <= F.col("fetch_k")).drop("fetch_k", "probe_id"))
    else:
        probes = wanted.withColumn("probe_id", F.col("query_id"))
        hits = (_nearest(probes, vectors, min_score, live).withColumnRenamed("probe_id", "query_id")
                .join(wanted.select("query_id", "vector_k"), "query_id"))
    rows = bounds.queries * fv.VECTOR_FETCH_CAP
    active_chunks = chunks.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("chunk_id"), "document_id")
    live_documents = documents.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("document_id"))
    # The few hits are the build sides; chunks and documents are scanned on three columns and not shuffled.
    # The exchange in between ends the scan of chunks before the next broadcast, whose timer then only sees few rows.
    live = active_chunks.join(broadcast_if(hits, rows, _CANDIDATE_BYTES), "chunk_id").hint("rebalance")
    live = live_documents.join(broadcast_if(live, rows, _CANDIDATE_BYTES), "document_id")
    order = Window.partitionBy("query_id").orderBy("vector_rank")
    return (live.withColumn("vector_rank", F.row_number().over(order))
            .filter(F.col("vector_rank") <= F.col("vector_k"))
            .select("query_id", "chunk_id", "vector_score", "vector_rank"))


# --- keyword branch -------------------------------------------------------------------------------------------

def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks the keyword search may return: active and vectorised."""
    return chunks.filter((F.col("status") == fv.ACTIVE) & (F.col("embedding_status") == fv.EMBEDDING_DONE))


def _first(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` lowest chunk ids per key; limited in every task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy("chunk_id")
    return rows.withColumn("keyword_rank", F.row_number().over(order)).filter(F.col("keyword_rank") <= most)


def keyword_candidates(queries: DataFrame, chunks: DataFrame, bounds: Bounds, options: Options = Options()) -> DataFrame:
    """``(query_id, chunk_id, keyword_rank)``: the ``candidate_k`` lowest chunk ids that contain any term.

    Terms are matched once each, however many queries share them. A query's first ``candidate_k`` chunks are among
    the first ``max(candidate_k)`` of each of its terms, so the matches of a frequent term shrink to that many per
    task before anything is shuffled, and queries meet only what is left. With ``candidate_order="score"`` it is the
    ``candidate_k`` best scored ones instead.
    """
    recall, folded = options.recall, tx.folded if options.match == "ci_ai" else F.lower
    if options.candidate_order not in ("chunk_id", "score"):
        raise ValueError(f"unknown candidate order: {options.candidate_order!r}")
    if options.candidate_order == "score":
        if recall:
            raise ValueError("recall by stored lists has no scores")
        texts = searchable(of_spaces(chunks, bounds)).select(
            F.col("id").alias("chunk_id"), "space_id", folded(F.col("content")).alias("text"), "content")
        return best_texts(texts, queries.filter("use_keyword").withColumn("asked", F.transform("terms", folded)))
    asked = (queries.filter("use_keyword")
             .select("query_id", "space_id", "candidate_k",
                     F.explode(F.array_distinct(F.transform("terms", folded))).alias("term")))
    texts = searchable(of_spaces(chunks, bounds)).select(
        F.col("id").alias("chunk_id"), "space_id", folded(F.col("content")).alias("text"))

    def matched(some: DataFrame, most: int | None) -> DataFrame:
        terms = some.select("space_id", "term").distinct()
        matches = recall(terms, most) if recall else contains_join(
            texts, terms, "text", "term", group="space_id", key="chunk_id", most=most)
        return (matches.join(some, ["space_id", "term"])
                .groupBy("query_id", "chunk_id").agg(F.any_value("candidate_k").alias("candidate_k")))

    # Spark limits groups in the tasks only up to a number; a query that asks for more is matched apart from the others.
    if bounds.candidate_k <= GROUP_LIMIT_MAX:
        found = matched(asked, bounds.candidate_k)
    else:
        wide = F.col("candidate_k") > GROUP_LIMIT_MAX
        found = matched(asked.filter(~wide), GROUP_LIMIT_MAX).unionByName(matched(asked.filter(wide), None))
    return (_first(found, ["query_id"], bounds.candidate_k)
            .filter(F.col("keyword_rank") <= F.col("candidate_k"))
            .select("query_id", "chunk_id", "keyword_rank"))


# --- merge, score, rank ---------------------------------------------------------------------------------------

def merge_candidates(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """One row per (query, chunk) with the ranks of the branches that found it."""
    merged = vector_hits.unionByName(keyword_hits, allowMissingColumns=True)
    return merged.groupBy("query_id", "chunk_id").agg(
        F.max("vector_score").alias("vector_score"), F.min("vector_rank").alias("vector_rank"),
        F.min("keyword_rank").alias("keyword_rank"))


def with_chunk(candidates: DataFrame, chunks: DataFrame, bounds: Bounds) -> DataFrame:
    """Candidates with their chunk's text; chunks are not shuffled, however many candidates there are."""
    rows = bounds.queries * (fv.VECTOR_TOP_K_MAX + bounds.candidate_k)
    full = chunks.select(F.col("id").alias("chunk_id"), "document_id", "space_id", "chunk_index", "content")
    return looked_up(full, candidates, "chunk_id", rows, _CANDIDATE_BYTES)


def score_candidates(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """All scores of merged candidates (with chunk text), each mode by its own rule.

    Keyword scores exist only where the keyword branch found the chunk. Best scores, for normalising, are taken over
    all candidates of the query.
    """
    asked = queries.select("query_id", "mode", "top_k", "vector_share", "keyword_share", "terms")
    # Candidates per query are bounded by 20 + candidate_k, so are the windows below.
    per_query = Window.partitionBy("query_id")

    def best(name: str) -> Column:
        return F.max(F.when(F.col(name) > 0, F.col(name))).over(per_query)

    known = (candidates.join(asked, "query_id")
             .withColumn("keyword_score", F.when(F.col("keyword_rank").isNotNull(),
                                                 scores.keyword_score(F.col("terms"), F.col("content")))))
    hybrid = scores.rounded(
        F.col("vector_share") * scores.max_normalised(F.col("vector_score"), F.col("_best_vector"))
        + F.col("keyword_share") * scores.max_normalised(F.col("keyword_score"), F.col("_best_keyword")))
    is_hybrid = F.col("mode").isin("HYBRID", "HYBRID_RERANK")
    reranked = F.col("mode") == "HYBRID_RERANK"
    scored = (known
              .withColumns({"_best_vector": best("vector_score"), "_best_keyword": best("keyword_score")})
              .withColumn("hybrid_score", F.when(is_hybrid, hybrid))
              .withColumns({
                  "exact_score": F.when(reranked, scores.exact_term_score(F.col("terms"), F.col("content"))),
                  "symbol_score": F.when(reranked, scores.symbol_score(F.col("terms"), F.col("content")))})
              .withColumn("rerank_score", F.when(
                  reranked, scores.rerank_score(F.col("hybrid_score"), F.col("exact_score"), F.col("symbol_score")))))
    final = (F.when(reranked, F.col("rerank_score")).when(is_hybrid, F.col("hybrid_score"))
             .when(F.col("mode") == "KEYWORD_ONLY", F.col("keyword_score")).otherwise(F.col("vector_score")))
    source = (F.when(F.col("vector_rank").isNull(), "KEYWORD").when(F.col("keyword_rank").isNull(), "VECTOR")
              .otherwise("BOTH"))
    return scored.withColumns({"final_score": final, "score": final, "retrieval_source": source})


def rank_candidates(scored: DataFrame) -> DataFrame:
    """The ``top_k`` rows per query; equal scores keep the merge order (vector hits, then keyword hits)."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last("final_score"), F.col("vector_rank").isNull(),
        F.coalesce("vector_rank", "keyword_rank"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("top_k"))


def candidates(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame,
               bounds: Bounds, options: Options = Options()) -> DataFrame:
    """Candidates of the branches that any query needs."""
    rank = F.lit(None).cast("int")
    if not bounds.by_vector:
        return keyword_candidates(queries, chunks, bounds, options).select(
            "query_id", "chunk_id", F.lit(None).cast("double").alias("vector_score"), rank.alias("vector_rank"),
            "keyword_rank")
    by_vector = vector_candidates(queries, chunks, vectors, documents, bounds, options.min_score, options.prefilter_active)
    if not bounds.by_keyword:
        return by_vector.withColumn("keyword_rank", rank)
    return merge_candidates(by_vector, keyword_candidates(queries, chunks, bounds, options))


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, spaces: DataFrame,
           options: Options = Options()) -> DataFrame:
    """Ranked chunks for every valid row of ``queries``; ``rejected`` lists the others.

    ``queries``: ``query_id, space_id, query, query_vec, retrieval_mode, top_k, candidate_k, vector_weight,
    keyword_weight`` and optionally ``probe_id``. Queries of all modes share the scans.
    """
    valid, bounds = prepare(queries, spaces)
    return search_valid(valid, chunks, vectors, documents, bounds, options)


def search_valid(valid: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, bounds: Bounds,
                 options: Options = Options()) -> DataFrame:
    found = with_chunk(candidates(valid, chunks, vectors, documents, bounds, options), chunks, bounds)
    return rank_candidates(score_candidates(found, valid)).select(*RESULT_COLUMNS)
