"""Rules of the search that a tiny hand-made knowledge base shows."""

import pytest
from pyspark.sql import functions as F

from kbspark.operators import retrieve

SPACES = [(1, 1), (2, 0)]
DOCUMENTS = [(1, 1), (2, 0), (3, 1), (9, 1)]
# id, document, space, index, content, embedding status, status
CHUNKS = [
    (10, 1, 1, 0, "alpha beta", 1, 1), (11, 1, 1, 1, "Alpha alpha OrderService", 1, 1),
    (12, 1, 1, 2, "gamma", 1, 0), (13, 2, 1, 0, "alpha in a deleted document", 1, 1),
    (14, 3, 1, 0, "alpha not vectorised", 2, 1), (15, 3, 1, 1, "delta", 1, 1), (16, 3, 1, 2, "beta", 1, 1),
    (20, 9, 2, 0, "alpha elsewhere", 1, 1)]
VECTORS = [(1, 10, [1.0, 0.0]), (1, 11, [0.8, 0.6]), (1, 12, [1.0, 0.1]), (1, 13, [1.0, 0.05]),
           (1, 15, [-1.0, 0.0]), (1, 16, [0.6, 0.8]), (1, 77, [1.0, 0.0]), (2, 20, [1.0, 0.0])]


@pytest.fixture(scope="module")
def kb(spark):
    return (
        spark.createDataFrame(CHUNKS, "id long, document_id long, space_id long, chunk_index int, content string, "
                                      "embedding_status int, status int"),
        spark.createDataFrame(VECTORS, "space_id long, chunk_id long, embedding array<float>"),
        spark.createDataFrame(DOCUMENTS, "id long, status int"), spark.createDataFrame(SPACES, "id long, status int"))


def asked(spark, *queries):
    names = ("query_id", "space_id", "query", "retrieval_mode", "top_k", "candidate_k", "vector_weight",
             "keyword_weight", "query_vec")
    rows = []
    for n, query in enumerate(queries):
        full = {"query_id": n, "space_id": 1, "query": "alpha", "top_k": None, "candidate_k": None,
                "vector_weight": None, "keyword_weight": None, "query_vec": [1.0, 0.0], "retrieval_mode": None, **query}
        rows.append(tuple(full[name] for name in names))
    return spark.createDataFrame(
        rows, "query_id long, space_id long, query string, retrieval_mode string, top_k int, candidate_k int, "
              "vector_weight double, keyword_weight double, query_vec array<float>")


def run(spark, kb, *queries):
    found = {n: [] for n in range(len(queries))}
    for row in retrieve.search(asked(spark, *queries), *kb).orderBy("query_id", "rank").collect():
        found[row.query_id].append(row)
    return found


def test_vector_only(spark, kb):
    hits = run(spark, kb, {}, {"top_k": 2}, {"top_k": 1})
    # Orphan 77, deleted chunk 12 and deleted document's 13 are fetched, then dropped.
    assert [row.chunk_id for row in hits[0]] == [10, 11, 16, 15]
    assert [row.final_score for row in hits[0]] == pytest.approx([1.0, 0.8, 0.6, -1.0])
    assert {row.retrieval_source for row in hits[0]} == {"VECTOR"}
    assert all(row.vector_score == row.final_score == row.score and row.keyword_score is None
               and row.hybrid_score is None for row in hits[0])
    assert [row.chunk_id for row in hits[1]] == [10, 11] and [row.chunk_id for row in hits[2]] == [10]


def test_fetch_counts_inactive_vectors(spark, kb):
    """Ten fetched vectors that are all inactive leave nothing, though an active one lies behind them."""
    chunks, _, documents, spaces = kb
    dead = [(1, 1000 + n, [1.0, 0.0]) for n in range(10)]
    vectors = spark.createDataFrame(dead + [(1, 10, [0.5, 0.5])], "space_id long, chunk_id long, embedding array<float>")
    query = asked(spark, {"top_k": 3})
    assert retrieve.search(query, chunks, vectors, documents, spaces).count() == 0
    assert retrieve.search(asked(spark, {"top_k": 4}), chunks, vectors, documents, spaces).count() == 1


def test_keyword_only(spark, kb):
    hits = run(spark, kb, {"retrieval_mode": "keyword_only"},
               {"retrieval_mode": "KEYWORD_ONLY", "top_k": 1, "candidate_k": 1},
               {"retrieval_mode": "KEYWORD_ONLY", "query": "alpha OrderService"},
               {"retrieval_mode": "KEYWORD_ONLY", "space_id": 2}, {"retrieval_mode": "KEYWORD_ONLY", "query": "zeta"})
    # The deleted document's chunk is found, the chunk without a vector is not; equal scores keep recall order.
    assert [(row.chunk_id, row.keyword_score) for row in hits[0]] == [(10, 1.0), (11, 1.0), (13, 1.0)]
    assert all(row.vector_score is None and row.rerank_score is None for row in hits[0])
    # The candidate limit cuts before scoring.
    assert [row.chunk_id for row in hits[1]] == [10]
    assert [row.chunk_id for row in hits[2]] == [11, 10, 13]
    assert [row.keyword_score for row in hits[2]] == pytest.approx([1.0, 0.53, 0.53])
    # Keyword search does not ask whether the space is active.
    assert [row.chunk_id for row in hits[3]] == [20] and hits[4] == []


def test_hybrid(spark, kb):
    hits = run(spark, kb, {"retrieval_mode": "HYBRID", "query": "alpha OrderService", "top_k": 10},
               {"retrieval_mode": "HYBRID", "vector_weight": 0.0, "keyword_weight": 0.0, "top_k": 10},
               {"retrieval_mode": "HYBRID", "vector_weight": -1.0, "keyword_weight": 0.7, "query": "zeta"},
               {"retrieval_mode": "HYBRID", "query": "alpha", "top_k": 3, "candidate_k": 3, "query_vec": [-1.0, 0.0]})
    by_chunk = {row.chunk_id: row for row in hits[0]}
    assert {n: row.retrieval_source for n, row in by_chunk.items()} == {
        10: "BOTH", 11: "BOTH", 13: "KEYWORD", 16: "VECTOR", 15: "VECTOR"}
    assert by_chunk[10].hybrid_score == pytest.approx(0.7 * 1 + 0.3 * 0.53, abs=1e-6)
    assert by_chunk[11].hybrid_score == pytest.approx(0.7 * 0.8 + 0.3 * 1.0, abs=1e-6)
    assert by_chunk[13].hybrid_score == pytest.approx(0.3 * 0.53, abs=1e-6)
    assert by_chunk[13].vector_score is None and by_chunk[16].keyword_score is None
    assert by_chunk[15].hybrid_score == 0 and by_chunk[15].rerank_score is None
    assert [row.chunk_id for row in hits[0]] == [11, 10, 16, 13, 15]
    # Both weights zero mean the defaults; a negative one means its default.
    assert hits[1][0].chunk_id == 10 and hits[1][0].hybrid_score == pytest.approx(1.0)
    assert hits[2][0].hybrid_score == pytest.approx(0.5)
    # Best vector score is taken over positive scores only.
    assert all(row.hybrid_score <= 1 for row in hits[3])


def test_vector_only_row_is_not_scored_again(spark, kb):
    """A text that holds the term but fell outside the keyword candidates has no keyword score."""
    hits = run(spark, kb, {"retrieval_mode": "HYBRID", "top_k": 2, "candidate_k": 2, "query": "alpha beta"},
               {"retrieval_mode": "HYBRID", "top_k": 3, "candidate_k": 3, "query": "alpha beta"})
    assert [(row.chunk_id, row.retrieval_source) for row in hits[0]] == [(10, "BOTH"), (11, "BOTH")]
    outside = [row for row in hits[1] if row.chunk_id == 16]
    assert outside and outside[0].keyword_score is None and outside[0].retrieval_source == "VECTOR"


def test_rerank(spark, kb):
    hits = run(spark, kb, {"retrieval_mode": "HYBRID_RERANK", "query": "alpha OrderService", "top_k": 10})
    by_chunk = {row.chunk_id: row for row in hits[0]}
    hybrid = 0.7 * 0.8 + 0.3 * 1.0
    assert by_chunk[11].rerank_score == pytest.approx(0.6 * hybrid + 0.25 * 1 + 0.15 * 1, abs=1e-6)
    assert by_chunk[10].rerank_score == pytest.approx(0.6 * (0.7 + 0.3 * 0.53) + 0.25 * 0.5, abs=1e-6)
    assert all(row.score == row.final_score == row.rerank_score for row in hits[0])


def test_rejects(spark, kb):
    queries = asked(spark, {"space_id": None}, {"query": " \n"}, {"space_id": 2}, {"space_id": 5},
                    {"space_id": 5, "retrieval_mode": "KEYWORD_ONLY"}, {"space_id": 2, "retrieval_mode": "HYBRID"}, {})
    errors = {row.query_id: row.error for row in retrieve.rejected(queries, kb[3]).collect()}
    assert errors == {0: "space_id missing", 1: "query blank", 2: "space not found", 3: "space not found",
                      5: "space not found"}


def test_limits(spark):
    rows = retrieve.resolve(asked(
        spark, {"top_k": 50}, {"top_k": 50, "retrieval_mode": "HYBRID"}, {"top_k": 0, "candidate_k": 3},
        {"top_k": 7, "candidate_k": 2, "retrieval_mode": "KEYWORD_ONLY"}, {"top_k": 1})).orderBy("query_id").collect()
    assert [(row.top_k, row.candidate_k, row.vector_k, row.fetch_k) for row in rows] == [
        (50, 50, 20, 60), (50, 50, 20, 60), (5, 5, 5, 15), (7, 7, 7, 21), (1, 20, 1, 10)]


def test_shared_probe_and_large_candidate_k(spark, kb):
    queries = asked(spark, {"top_k": 1}, {"top_k": 3}, {"retrieval_mode": "HYBRID"},
                    {"retrieval_mode": "KEYWORD_ONLY", "candidate_k": 5000}).withColumn("probe_id", F.lit("same"))
    alone = retrieve.search(queries.drop("probe_id"), *kb)
    shared = retrieve.search(queries, *kb)
    assert sorted(map(tuple, shared.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)


def test_hits_do_not_depend_on_other_queries(spark, kb):
    """A vector of space 1 whose chunk has moved to space 2 is found, whoever else asks."""
    chunks, vectors, documents, spaces = kb
    moved = chunks.withColumn("space_id", F.lit(2).cast("long"))
    alone, with_other = [
        {(row.query_id, row.chunk_id) for row in retrieve.search(asked(spark, *queries), moved, vectors, documents, spaces)
         .filter("query_id = 0").collect()} for queries in ([{"top_k": 3}], [{"top_k": 3}, {"space_id": 2}])]
    assert alone and alone == with_other


def test_one_wide_query_does_not_widen_the_others(spark, kb):
    queries = [{"retrieval_mode": "KEYWORD_ONLY", "candidate_k": k} for k in (1, 2, 5000)]
    together = run(spark, kb, *queries)
    for n, query in enumerate(queries):
        assert [row.chunk_id for row in run(spark, kb, query)[0]] == [row.chunk_id for row in together[n]]


def test_keyword_recall_stays_in_the_jvm(spark, kb):
    found = retrieve.search(asked(spark, {"retrieval_mode": "KEYWORD_ONLY"}), *kb)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert "Arrow" not in found._jdf.queryExecution().toString()


def test_chunks_are_not_shuffled(spark, kb, tmp_path):
    """Neither texts nor vectors pass an exchange: candidates and hits are the build sides."""
    names = ("chunks", "vectors", "documents", "spaces")
    for name, rows in zip(names, kb):
        rows.write.parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{name}") for name in names]
    found = retrieve.search(asked(spark, {"retrieval_mode": "HYBRID_RERANK"}), *stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_live_vectors_are_fetched(spark, kb):
    """Ten inactive vectors no longer push the active one out, however many ids fit a broadcast."""
    chunks, _, documents, spaces = kb
    dead = [(1, 1000 + n, [1.0, 0.0]) for n in range(10)] + [(1, 12, [1.0, 0.0]), (1, 13, [1.0, 0.0])]
    vectors = spark.createDataFrame(dead + [(1, 10, [0.5, 0.5]), (1, 11, [0.4, 0.6])], "space_id long, chunk_id long, embedding array<float>")
    query = asked(spark, {"top_k": 3}, {"top_k": 1, "query_vec": [0.0, 1.0]})
    for bound in ("1000000", "200"):
        spark.conf.set("kbspark.maxBroadcastBytes", bound)
        try:
            found = retrieve.search(query, chunks, vectors, documents, spaces, retrieve.Options(prefilter_active=True)).collect()
        finally:
            spark.conf.unset("kbspark.maxBroadcastBytes")
        assert sorted((r.query_id, r.rank, r.chunk_id) for r in found) == [(0, 1, 10), (0, 2, 11), (1, 1, 11)]


def test_accents_are_folded_on_request(spark):
    rows = [(1, "Über Café Ñandú"), (2, "uber cafe nandu"), (3, "Über"), (4, "Straße"), (5, "ἀλφα"), (6, "漢字")]
    chunks = spark.createDataFrame([(n, 1, 1, n, text, 1, 1) for n, text in rows],
                                   "id long, document_id long, space_id long, chunk_index int, content string, "
                                   "embedding_status int, status int")
    documents, spaces = (spark.createDataFrame([(1, 1)], "id long, status int") for _ in range(2))
    vectors = spark.createDataFrame([], "space_id long, chunk_id long, embedding array<float>")
    words = ["uber", "CAFÉ", "Strasse", "straße", "αλφα", "漢字"]
    query = asked(spark, *[{"query": word, "retrieval_mode": "KEYWORD_ONLY"} for word in words])
    got = {name: {} for name in ("ci", "ci_ai")}
    for name, found in got.items():
        for row in retrieve.search(query, chunks, vectors, documents, spaces, retrieve.Options(match=name)).collect():
            found.setdefault(words[row.query_id], set()).add(row.chunk_id)
    assert got["ci"] == {"uber": {2}, "CAFÉ": {1}, "straße": {4}, "漢字": {6}}
    assert got["ci_ai"] == {"uber": {1, 2, 3}, "CAFÉ": {1, 2}, "straße": {4}, "αλφα": {5}, "漢字": {6}}
