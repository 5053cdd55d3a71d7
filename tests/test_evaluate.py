import random

import pytest
from pyspark.sql import functions as F

from kbspark import fixed_values as fv
from kbspark.operators import eval_store, evaluate


def model(expected, retrieved):
    wanted, got = set(expected or []), retrieved or []
    if not wanted or not got:
        return 0.0, 0, 0.0
    ranks = [n for n, one in enumerate(got, 1) if one in wanted]
    return len(wanted & set(got)) / len(wanted), int(bool(ranks)), 1 / ranks[0] if ranks else 0.0


def test_list_metrics(spark):
    rng = random.Random(1)
    lists = [([], [1]), ([1], []), (None, [1]), ([1], None), ([1, 1, 2], [3, 2, 2]), ([5], [5])]
    lists += [([rng.randint(1, 9) for _ in range(rng.randint(0, 5))], rng.sample(range(1, 10), rng.randint(0, 6)))
              for _ in range(100)]
    frame = spark.createDataFrame([(n, *pair) for n, pair in enumerate(lists)], "n int, e array<long>, r array<long>")
    e, r = F.col("e"), F.col("r")
    for row in frame.select("n", evaluate.recall_at_k(e, r).alias("a"), evaluate.hit_at_k(e, r).alias("b"),
                            evaluate.reciprocal_rank(e, r).alias("c")).collect():
        assert (row.a, row.b, row.c) == pytest.approx(model(*lists[row.n])), lists[row.n]


def test_keyword_hit_and_json(spark):
    frame = spark.createDataFrame(
        [(1, "Alpha beta", ["ALPHA", "gamma", " "]), (2, None, ["a"]), (3, " ", ["a"]), (4, "a", []), (5, "a", None)],
        "n int, answer string, words array<string>")
    hits = {row.n: row.hit for row in frame.select(
        "n", evaluate.keyword_hit(F.col("answer"), F.col("words")).alias("hit")).collect()}
    assert hits == pytest.approx({1: 1 / 3, 2: 0, 3: 0, 4: 0, 5: 0})
    written = {row.n: row.json for row in frame.select("n", evaluate.write_list(F.col("words")).alias("json")).collect()}
    assert written == {1: '["ALPHA","gamma"," "]', 2: '["a"]', 3: '["a"]', 4: "[]", 5: "[]"}
    texts = spark.createDataFrame([(1, "[1,2]"), (2, None), (3, " "), (4, "[1,"), (5, "{}"), (6, "oops"), (7, "[]")],
                                  "n int, json string")
    read = {row.n: row.ids for row in texts.select("n", evaluate.read_list(F.col("json"), "long").alias("ids")).collect()}
    assert read[1] == [1, 2] and all(read[n] == [] for n in range(2, 8))


def judged_rows(spark):
    return spark.createDataFrame(
        [("1:1", 1, 1, "q", ["x"], True, None, 5), ("1:2", 1, 2, "q", ["x"], True, None, 5),
         ("2:1", 2, 1, "q", ["x"], False, None, 5), ("3:1", 3, 1, "q", ["x"], True, "space not found", 5),
         ("4:1", 4, 1, "q", ["x"], True, "space not found", 5), ("4:2", 4, 2, "q", ["x"], True, None, 5)],
        "query_id string, run_id long, case_id long, query string, expected_keywords array<string>, "
        "with_answer boolean, error string, top_k int")


def test_case_results_and_summary(spark):
    hits = spark.createDataFrame(
        [("1:1", 1, 7, "no"), ("1:1", 2, 8, "has X"), ("2:1", 1, 8, "has X"), ("4:2", 1, 5, "x")],
        "query_id string, rank int, chunk_id long, content string")
    expected = spark.createDataFrame([(1, 8), (1, 8), (1, 9)], "case_id long, chunk_id long")
    results = evaluate.case_results(judged_rows(spark), hits, expected, answer=evaluate.best_chunk_answer(),
                                    latency=F.col("case_id") * 10)
    rows = {(row.run_id, row.case_id): row for row in results.collect()}
    first = rows[1, 1]
    assert (first.retrieved_chunk_ids, first.recall_at_k, first.hit_at_k, first.mrr) == ([7, 8], 0.5, 1, 0.5)
    assert (first.answer, first.answer_keyword_hit, first.citation_correct, first.grounded) == ("no", 0, 1, 1)
    none = rows[1, 2]
    assert (none.answer, none.retrieved_chunk_ids, none.expected_count, none.grounded) == (fv.NO_HIT_ANSWER, [], 0, 0)
    assert rows[2, 1].answer is None and rows[2, 1].mrr == 1.0
    failed = rows[3, 1]
    assert (failed.error_message, failed.answer, failed.retrieved_chunk_ids, failed.recall_at_k, failed.grounded) == (
        "space not found", None, None, 0, 0)
    given = evaluate.case_results(
        judged_rows(spark), hits, expected,
        answers=spark.createDataFrame([("1:1", "an X"), ("2:1", "x")], "query_id string, answer string"))
    assert {(row.run_id, row.case_id): row.answer_keyword_hit for row in given.collect()}[1, 1] == 1.0
    summary = {row.run_id: row for row in evaluate.summarise_runs(results).collect()}
    assert (summary[1].avg_recall_at_k, summary[1].hit_rate_at_k, summary[1].mrr, summary[1].avg_latency_ms) == (
        0.25, 0.5, 0.25, 15.0)
    assert {run: (row.total_case_count, row.success_case_count, row.failed_case_count, row.status)
            for run, row in summary.items()} == {1: (2, 2, 0, 2), 2: (1, 1, 0, 2), 3: (1, 0, 1, 3), 4: (2, 1, 1, 4)}
    assert (summary[3].avg_recall_at_k, summary[3].avg_latency_ms, summary[4].avg_latency_ms) == (0.0, 0.0, 20.0)


def test_expected_lists_become_rows(spark):
    cases = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None)], "id long, expected_chunk_ids array<long>")
    assert sorted(map(tuple, evaluate.expected_chunks(cases).collect())) == [(1, 3), (1, 4)]


def test_comparison(spark):
    runs = spark.createDataFrame(
        [(1, 0.5, 0.5, 0.2, 30.0), (2, 0.5, 0.9, None, 10.0), (3, None, 0.9, 0.4, None), (4, 0.1, 0.1, 0.1, 10.0)],
        "id long, avg_recall_at_k double, hit_rate_at_k double, mrr double, avg_latency_ms double")
    comparisons = spark.createDataFrame(
        [(1, [1, 2, 3, 2, 4]), (2, [4, 4]), (3, [1]), (4, [1, None]), (5, [1, 8]), (6, []), (7, None), (8, [3, 3])],
        "comparison_id long, run_ids array<long>")
    errors = {row.comparison_id: row.error for row in evaluate.comparison_errors(comparisons, runs).collect()}
    assert errors == {3: "fewer than two runs", 4: "run id missing", 5: "run not found", 6: "run ids missing",
                      7: "run ids missing"}
    items = evaluate.compare_runs(comparisons, runs)
    rows = {(row.comparison_id, row.order_index): row for row in items.collect()}
    assert sorted(rows) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (8, 1)]
    assert [rows[1, n].run_id for n in range(1, 5)] == [1, 2, 3, 4]
    assert (rows[1, 3].delta_avg_recall_at_k, rows[1, 3].delta_avg_latency_ms) == (-0.5, -30.0)
    assert (rows[1, 2].delta_mrr, rows[1, 2].delta_hit_rate_at_k) == (-0.2, 0.4)
    best = {row.comparison_id: row for row in evaluate.comparison_summary(evaluate.best_runs(items)).collect()}
    assert (best[1].best_recall_run_id, best[1].best_hit_rate_run_id, best[1].best_mrr_run_id,
            best[1].fastest_run_id, best[1].compared_run_count, best[1].baseline_run_id) == (1, 2, 3, 2, 4, 1)
    assert best[8].fastest_run_id is None and fv.COMPARE_SUMMARY_FASTEST not in best[8].summary
    assert best[2].summary == (
        "本次共对比 1 次评测运行。 Recall@K 最优的 runId 为 4。 Hit@K 最优的 runId 为 4。 MRR 最优的 runId 为 4。"
        " 平均延迟最低的 runId 为 4。 delta 字段表示相对于第一个 runId 的变化量。")


def test_run_defaults(spark):
    requests = spark.createDataFrame(
        [(1, 1, None, None, None, None, None, None, None), (2, 1, " n ", " hybrid ", 3, 7, 0.1, 0.2, True),
         (3, 1, " ", " ", 0, -1, None, None, False)],
        "id long, dataset_id long, run_name string, retrieval_mode string, top_k int, candidate_k int, "
        "vector_weight double, keyword_weight double, enable_answer_generation boolean")
    rows = {row.id: tuple(row)[2:] for row in evaluate.configure_runs(requests, F.lit("auto")).collect()}
    assert rows == {1: ("auto", "VECTOR_ONLY", 5, 20, None, None, 0, 0),
                    2: (" n ", " hybrid ", 3, 7, 0.1, 0.2, 1, 0), 3: ("auto", "VECTOR_ONLY", 5, 20, None, None, 0, 0)}


def test_validity(spark):
    datasets = spark.createDataFrame([(1, 1, "d", 1), (2, None, "d", 1), (3, 1, " ", 0)],
                                     "id long, space_id long, name string, status int")
    assert {row.id: row.error for row in evaluate.dataset_errors(datasets).collect()} == {
        2: "space_id missing", 3: "name blank"}
    cases = spark.createDataFrame([(1, 1, "q"), (2, 3, "q"), (3, 1, " ")], "id long, dataset_id long, question string")
    assert {row.id: row.error for row in evaluate.case_errors(cases, datasets).collect()} == {
        2: "dataset not found", 3: "question blank"}


def test_only_new_pairs_are_searched(spark, tmp_path):
    chunks = spark.createDataFrame([(10, 1, 1, 0, "alpha beta", 1, 1), (11, 1, 1, 1, "beta", 1, 1)],
                                   "id long, document_id long, space_id long, chunk_index int, content string, embedding_status int, status int")
    vectors = spark.createDataFrame([], "space_id long, chunk_id long, embedding array<float>")
    alive = spark.createDataFrame([(1, 1)], "id long, status int")
    datasets = spark.createDataFrame([(1, 1, 1), (2, 9, 1)], "id long, space_id long, status int")
    kind = "id long, dataset_id long, question string, query_vec array<float>, expected_keywords array<string>, status int"
    asks = [(1, 1, "alpha", [1.0], ["beta"], 1), (2, 1, "beta", [1.0], ["x"], 1), (3, 2, "beta", [1.0], [], 1)]
    run = "id long, dataset_id long, retrieval_mode string, top_k int, candidate_k int, vector_weight double, keyword_weight double, enable_answer_generation int"
    runs = spark.createDataFrame([(1, 1, "KEYWORD_ONLY", 5, 5, None, None, 1), (2, 1, " keyword_only", 5, 5, 0.7, 0.3, 1),
                                  (3, 2, "HYBRID", 5, 5, None, None, 1)], run)
    expected = spark.createDataFrame([(1, 10), (1, 10), (2, 11)], "case_id long, chunk_id long")
    store = eval_store.EvaluationStore(spark, str(tmp_path))

    def check(cases, expected, version="v1"):
        content = (datasets, spark.createDataFrame(cases, kind), expected, chunks, vectors, alive, alive)
        told = {"answer": evaluate.best_chunk_answer(), "latency": F.col("run_id") + F.col("case_id")}
        found = eval_store.evaluate_stored(store, version, runs, *content, **told)
        plain = evaluate.evaluate(runs, *content, **told).select(*found.columns)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
        return store.read(version).count(), len(list(tmp_path.glob(f"version={version}/batch-*")))

    # Runs with equal settings share results; a query in an unknown space is an error and not stored.
    assert check(asks, expected) == (2, 1)
    assert check(asks, expected) == (2, 1)
    # A case that asks otherwise, and one that expects otherwise, are new.
    asks[0] = (1, 1, "alpha beta", [1.0], ["beta"], 1)
    assert check(asks, expected) == (3, 2)
    assert check(asks, expected.unionByName(spark.createDataFrame([(2, 10)], expected.schema))) == (4, 3)
    store.merge("v1")
    assert check(asks, expected) == (4, 1)
    # Results of other content are others; rows cut off before the rename do not count.
    store.read("v1").write.parquet(f"{tmp_path}/version=v2/.batch-cut")
    assert check(asks, expected, "v2") == (2, 1)
    # Two writers of the same results.
    store.add("v2", store.read("v2"))
    assert check(asks, expected, "v2") == (2, 2)
    with pytest.raises(ValueError):
        store.read("../v1")
