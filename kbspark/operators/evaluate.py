"""Retrieval evaluation: many runs over their cases in one job, run summaries, and run comparison."""

from pyspark.sql import Column, DataFrame, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import codes, scores, text as tx
from kbspark.operators import retrieve
from kbspark.operators.limits import pin


# --- JSON lists -----------------------------------------------------------------------------------------------

def write_list(values: Column) -> Column:
    return F.coalesce(F.to_json(values), F.lit("[]"))


def read_list(json: Column, kind: str) -> Column:
    """A JSON list; empty for null, blank or malformed text."""
    empty = F.array().cast(f"array<{kind}>")
    return F.coalesce(F.from_json(json, f"array<{kind}>"), empty)


# --- validity and defaults ------------------------------------------------------------------------------------

def dataset_errors(datasets: DataFrame) -> DataFrame:
    error = (F.when(F.col("space_id").isNull(), "space_id missing")
             .when(~tx.has_text(F.col("name")), "name blank"))
    return datasets.select("id", error.alias("error")).filter(F.col("error").isNotNull())


def case_errors(cases: DataFrame, datasets: DataFrame) -> DataFrame:
    live = datasets.filter(F.col("status") == fv.ACTIVE).select(
        F.col("id").alias("dataset_id"), F.lit(True).alias("_live"))
    error = (F.when(F.col("_live").isNull(), "dataset not found")
             .when(~tx.has_text(F.col("question")), "question blank"))
    return (cases.select("id", "dataset_id", "question").join(live, "dataset_id", "left")
            .select("id", error.alias("error")).filter(F.col("error").isNotNull()))


def configure_runs(requests: DataFrame, default_name: Column) -> DataFrame:
    """Run rows from requests. The given mode text is kept; ``default_name`` names runs without a name."""
    return requests.select(
        "id", "dataset_id",
        F.when(tx.has_text(F.col("run_name")), F.col("run_name")).otherwise(default_name).alias("run_name"),
        F.when(tx.has_text(F.col("retrieval_mode")), F.col("retrieval_mode"))
        .otherwise(fv.MODES[0]).alias("retrieval_mode"),
        F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(fv.DEFAULT_TOP_K).alias("top_k"),
        F.when(F.col("candidate_k") > 0, F.col("candidate_k")).otherwise(fv.DEFAULT_CANDIDATE_K)
        .alias("candidate_k"),
        "vector_weight", "keyword_weight",
        F.coalesce("enable_answer_generation", F.lit(False)).cast("int").alias("enable_answer_generation"),
        F.lit(fv.STATUS_PENDING).alias("status"))


# --- metrics on id lists --------------------------------------------------------------------------------------

def recall_at_k(expected: Column, retrieved: Column) -> Column:
    share = F.try_divide(F.size(F.array_intersect(expected, retrieved)), F.size(F.array_distinct(expected)))
    return F.coalesce(share, F.lit(0.0))


def hit_at_k(expected: Column, retrieved: Column) -> Column:
    return F.coalesce(F.arrays_overlap(expected, retrieved), F.lit(False)).cast("int")


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    found = F.array_position(F.transform(retrieved, lambda one: F.array_contains(expected, one)), True)
    return F.coalesce(F.try_divide(F.lit(1.0), found), F.lit(0.0))


def keyword_hit(answer: Column, keywords: Column) -> Column:
    """Share of all keywords that are visible text and occur in the answer, case ignored."""
    found = F.size(F.filter(
        keywords, lambda word: tx.has_text(word) & F.contains(F.lower(answer), F.lower(word))))
    return F.when(tx.has_text(answer) & (F.size(keywords) > 0),
                  F.try_divide(found, F.size(keywords))).otherwise(0.0)


# --- runs -----------------------------------------------------------------------------------------------------

def expected_chunks(cases: DataFrame) -> DataFrame:
    """``(case_id, chunk_id)`` from cases with an ``expected_chunk_ids`` list."""
    return cases.select(F.col("id").alias("case_id"), F.explode("expected_chunk_ids").alias("chunk_id"))


def run_queries(runs: DataFrame, datasets: DataFrame, cases: DataFrame) -> DataFrame:
    """One search query per run and active case; the cases' vectors are shared by all runs."""
    live = datasets.filter(F.col("status") == fv.ACTIVE).select(F.col("id").alias("dataset_id"), "space_id")
    asked = cases.filter(F.col("status") == fv.ACTIVE).select(
        F.col("id").alias("case_id"), "dataset_id", F.col("question").alias("query"), "query_vec",
        "expected_keywords")
    settings = runs.select(
        F.col("id").alias("run_id"), "dataset_id", "retrieval_mode", "top_k", "candidate_k", "vector_weight",
        "keyword_weight", F.col("enable_answer_generation").cast("boolean").alias("with_answer"))
    joined = asked.join(settings, "dataset_id").join(live, "dataset_id")
    return joined.select(
        F.concat_ws(":", F.col("run_id").cast("string"), F.col("case_id").cast("string")).alias("query_id"),
        F.col("case_id").alias("probe_id"), "*")


def run_rejects(runs: DataFrame, datasets: DataFrame, cases: DataFrame) -> DataFrame:
    """``(run_id, reason)`` of the runs that cannot be evaluated; the others have at least one case."""
    known = datasets.select(F.col("id").alias("dataset_id"), (F.col("status") == fv.ACTIVE).alias("live"))
    # A data set's cases are counted in every task first.
    asked = cases.filter(F.col("status") == fv.ACTIVE).groupBy("dataset_id").agg(F.count("*").alias("cases"))
    reason = (F.when(F.col("live").isNull(), "dataset not found").when(~F.col("live"), "dataset inactive")
              .when(F.col("cases").isNull(), "no active case"))
    return runs.select(F.col("id").alias("run_id"), "dataset_id").join(known, "dataset_id", "left").join(
        asked, "dataset_id", "left").select("run_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def best_chunk_answer() -> Column:
    """A deterministic stand-in for a generated answer: the text of the best hit."""
    return F.max(F.when(F.col("rank") == 1, F.col("content")))


def evaluate(runs: DataFrame, datasets: DataFrame, cases: DataFrame, expected: DataFrame, chunks: DataFrame,
             vectors: DataFrame, documents: DataFrame, spaces: DataFrame, answer: Column | None = None,
             answers: DataFrame | None = None, latency: Column | None = None) -> DataFrame:
    """Case results of all runs.

    ``expected`` has one row ``(case_id, chunk_id)`` per expected chunk: a passage that a third of all chunks repeat
    is then counted by many tasks and never gathered into one list. Answers come from ``answers``, a table
    ``(query_id, answer)``, or from ``answer``, an aggregate over a query's hits. ``latency`` is an expression over
    run and case columns, since a set-based job has no per-case timer.
    """
    judged = pin(retrieve.judge(run_queries(runs, datasets, cases), spaces), "eval-queries")
    valid = judged.filter(F.col("error").isNull())
    hits = retrieve.search_valid(valid, chunks, vectors, documents, retrieve.measure(valid))
    # Counted and met: what it rests on, a join with all texts, is computed once.
    expected = pin(expected.select("case_id", "chunk_id").distinct(), "eval-expected")
    return case_results(judged, hits, expected, answer, answers, latency)


def case_results(judged: DataFrame, hits: DataFrame, expected: DataFrame, answer: Column | None = None,
                 answers: DataFrame | None = None, latency: Column | None = None) -> DataFrame:
    """Metrics per run and case from judged queries and their hits; rejected queries become error rows."""
    text = F.lit(None).cast("string")
    wanted = expected.select("case_id", "chunk_id").distinct()
    sizes = wanted.groupBy("case_id").agg(F.count("*").alias("expected_count"))
    # The key holds the chunk as well, so no case is a hot key however many chunks it expects.
    flagged = (hits.select("query_id", "rank", "chunk_id", "content")
               .join(judged.select("query_id", "case_id"), "query_id")
               .join(wanted.withColumn("_wanted", F.lit(True)), ["case_id", "chunk_id"], "left"))
    # A query has at most top_k hits, which bounds the list.
    found = flagged.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda hit: hit["chunk_id"])
        .alias("retrieved_chunk_ids"),
        F.count("_wanted").alias("matched"), F.min(F.when(F.col("_wanted"), F.col("rank"))).alias("first_rank"),
        (answer if answer is not None else F.any_value(text)).alias("answer"))
    table = (judged.select("query_id", "run_id", "case_id", "query", "expected_keywords", "with_answer", "error",
                           (latency if latency is not None else F.lit(None)).cast("long").alias("latency_ms"))
             .join(found, "query_id", "left").join(sizes, "case_id", "left"))
    if answers is not None:
        table = table.drop("answer").join(answers.select("query_id", "answer"), "query_id", "left")
    failed = F.col("error").isNotNull()
    said = F.when(F.col("with_answer") & ~failed,
                  F.when(F.col("retrieved_chunk_ids").isNull(), fv.NO_HIT_ANSWER).otherwise(F.col("answer")))
    hit = (F.coalesce("matched", F.lit(0)) > 0).cast("int")
    none = F.array().cast("array<long>")
    return table.withColumn("answer", said).select(
        "run_id", "case_id", F.col("query").alias("question"), "answer",
        F.when(~failed, F.coalesce("retrieved_chunk_ids", none)).alias("retrieved_chunk_ids"),
        F.coalesce("expected_count", F.lit(0)).alias("expected_count"),
        scores.rounded(F.coalesce(F.try_divide("matched", "expected_count"), F.lit(0.0))).alias("recall_at_k"),
        hit.alias("hit_at_k"),
        scores.rounded(F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0))).alias("mrr"),
        scores.rounded(keyword_hit(F.col("answer"), F.col("expected_keywords"))).alias("answer_keyword_hit"),
        hit.alias("citation_correct"),
        F.col("retrieved_chunk_ids").isNotNull().cast("int").alias("grounded"),
        "latency_ms", F.col("error").alias("error_message"))


def summarise_runs(results: DataFrame) -> DataFrame:
    """Averages over the cases without error (null counts as 0; zeros when there is none), counts, and status."""
    good = F.col("error_message").isNull()

    def mean(name: str) -> Column:
        value = F.avg(F.when(good, F.coalesce(F.col(name).cast("double"), F.lit(0.0))))
        return scores.rounded(F.coalesce(value, F.lit(0.0)))

    counted = results.groupBy("run_id").agg(
        F.count("*").alias("total_case_count"), F.count_if(good).alias("success_case_count"),
        F.count_if(~good).alias("failed_case_count"), mean("recall_at_k").alias("avg_recall_at_k"),
        mean("hit_at_k").alias("hit_rate_at_k"), mean("mrr").alias("mrr"),
        mean("answer_keyword_hit").alias("avg_answer_keyword_hit"),
        mean("citation_correct").alias("citation_correct_rate"), mean("latency_ms").alias("avg_latency_ms"))
    return counted.withColumn(
        "status", codes.run_status(F.col("success_case_count"), F.col("failed_case_count")))


# --- comparison -----------------------------------------------------------------------------------------------

def comparison_errors(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """Invalid comparisons ``(comparison_id, run_ids)``: fewer than two ids, a null id, or an unknown run."""
    ids = F.col("run_ids")
    plain = comparisons.select(
        "comparison_id",
        F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "run ids missing")
        .when(F.size(ids) < 2, "fewer than two runs")
        .when(F.exists(ids, lambda one: one.isNull()), "run id missing").alias("error"))
    known = runs.select(F.col("id").alias("run_id"))
    unknown = (comparisons.select("comparison_id", F.explode("run_ids").alias("run_id"))
               .filter(F.col("run_id").isNotNull()).join(known, "run_id", "left_anti")
               .select("comparison_id", F.lit("run not found").alias("unknown")).distinct())
    return (plain.join(unknown, "comparison_id", "left")
            .select("comparison_id", F.coalesce("error", "unknown").alias("error"))
            .filter(F.col("error").isNotNull()))


def compare_runs(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per compared run, in the given order without repeats, with deltas to the first run."""
    valid = comparisons.join(comparison_errors(comparisons, runs), "comparison_id", "left_anti")
    ordered = (valid.select("comparison_id", F.posexplode("run_ids").alias("_at", "run_id"))
               .groupBy("comparison_id", "run_id").agg(F.min("_at").alias("_at")))
    metrics = {"avg_recall_at_k": "delta_avg_recall_at_k", "hit_rate_at_k": "delta_hit_rate_at_k",
               "mrr": "delta_mrr", "avg_latency_ms": "delta_avg_latency_ms"}
    items = ordered.join(runs.withColumnRenamed("id", "run_id"), "run_id")
    # Order among the distinct ids: the number of distinct ids placed no later.
    places = ordered.groupBy("comparison_id").agg(F.sort_array(F.collect_list("_at")).alias("_places"))
    base = items.filter("_at = 0").select(
        "comparison_id", F.col("run_id").alias("baseline_run_id"),
        *[F.coalesce(name, F.lit(0.0)).alias(f"_{name}") for name in metrics])
    full = items.join(places, "comparison_id").join(base, "comparison_id").withColumn(
        "order_index", F.array_position("_places", F.col("_at")).cast("int"))
    deltas = [scores.rounded(F.coalesce(F.col(name), F.lit(0.0)) - F.col(f"_{name}")).alias(delta)
              for name, delta in metrics.items()]
    return full.select("comparison_id", "baseline_run_id", "order_index", "run_id",
                       *[name for name in runs.columns if name != "id"], *deltas)


def best_runs(items: DataFrame) -> DataFrame:
    """Best and fastest run per comparison; the earlier one wins a tie."""
    def best(name: str) -> Column:
        return F.max_by("run_id", F.struct(F.coalesce(F.col(name), F.lit(0.0)), -F.col("order_index")))

    timed = F.when(F.col("avg_latency_ms").isNotNull(), F.struct("avg_latency_ms", "order_index"))
    return items.groupBy("comparison_id").agg(
        F.any_value("baseline_run_id").alias("baseline_run_id"),
        F.count("*").cast("int").alias("compared_run_count"),
        best("avg_recall_at_k").alias("best_recall_run_id"), best("hit_rate_at_k").alias("best_hit_rate_run_id"),
        best("mrr").alias("best_mrr_run_id"), F.min_by("run_id", timed).alias("fastest_run_id"))


def comparison_summary(best: DataFrame) -> DataFrame:
    """``best_runs`` with the summary sentence."""
    def part(label: str, run: str) -> Column:
        return F.coalesce(
            F.concat(F.lit(label), F.col(run).cast("string"), F.lit(fv.COMPARE_SUMMARY_STOP)), F.lit(""))

    head, tail = fv.COMPARE_SUMMARY_HEAD
    return best.withColumn("summary", F.concat(
        F.lit(head), F.col("compared_run_count").cast("string"), F.lit(tail),
        part(fv.COMPARE_SUMMARY_RECALL, "best_recall_run_id"), part(fv.COMPARE_SUMMARY_HIT, "best_hit_rate_run_id"),
        part(fv.COMPARE_SUMMARY_MRR, "best_mrr_run_id"), part(fv.COMPARE_SUMMARY_FASTEST, "fastest_run_id"),
        F.lit(fv.COMPARE_SUMMARY_TAIL)))
