"""Results of evaluations, kept under what they rest on, so that only what was never asked is searched.

The key of a pair of run and case is a hash of the run's settings and of all that the case asks and expects; the
version names the content that was searched. Runs with equal settings, a run that is made again, and a new run over
cases of which most are old share results. A search writes its results into a folder of its own, which then appears
by a rename: a failed job leaves nothing that counts, and readers see whole batches only. Of results that two writers
made side by side, one counts.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark.operators import evaluate, retrieve
from kbspark.operators.limits import pin

_SETTINGS = ["space_id", "mode", "top_k", "candidate_k", "vector_share", "keyword_share", "with_answer"]

SCHEMA = ("key string, answer string, retrieved_chunk_ids array<long>, expected_count long, recall_at_k double, "
          "hit_at_k int, mrr double, answer_keyword_hit double, citation_correct int, grounded int")

_RESULT = [part.split()[0] for part in SCHEMA.split(", ")][1:]


class EvaluationStore:
    """Results below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, version: str) -> str:
        if not version or not version.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a version name: {version!r}")
        return f"{self.root}/version={version}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def read(self, version: str) -> DataFrame:
        """The results of a version, one per key; those of other versions are not opened."""
        folder = self._folder(version)
        path = self._path(f"{folder}/batch-*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        rows = (self.spark.read.schema(SCHEMA).parquet(*[one.getPath().toString() for one in found]) if len(found)
                else self.spark.createDataFrame([], SCHEMA))
        if len(found) < 2:
            return rows
        return rows.groupBy("key").agg(F.min_by(F.struct(*_RESULT), F.xxhash64("retrieved_chunk_ids", "answer")).alias("r")).select("key", "r.*")

    def add(self, version: str, rows: DataFrame) -> None:
        name, folder = uuid.uuid4().hex, self._folder(version)
        rows.select("key", *_RESULT).write.parquet(f"{folder}/.batch-{name}")
        aside = self._path(f"{folder}/.batch-{name}")
        if not aside.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(aside, self._path(f"{folder}/batch-{name}")):
            raise RuntimeError(f"results could not be moved to {folder}/batch-{name}")

    def merge(self, version: str) -> None:
        """Puts the batches of a version into one; only when nobody reads or writes the version."""
        path = self._path(f"{self._folder(version)}/batch-*")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [one.getPath() for one in files.globStatus(path) or []]
        if len(old) > 1:
            self.add(version, self.read(version))
            for one in old:
                files.delete(one, True)


def _keys(judged: DataFrame, expected: DataFrame) -> DataFrame:
    """Valid judged queries with the key of what their result rests on; ``expected`` without repeats."""
    # Order-free and summed in the tasks first: a chunk list of any length becomes one row per task.
    expects = expected.groupBy("case_id").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("chunk_id")).alias("_x"),
        F.bit_xor(F.xxhash64("chunk_id", F.lit(1))).alias("_y"))
    parts: list[Column] = [F.col(name) for name in [*_SETTINGS, "query", "query_vec", "expected_keywords", "_n", "_x", "_y"]]
    return (judged.filter(F.col("error").isNull()).join(expects, "case_id", "left")
            .withColumn("key", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)).drop("_n", "_x", "_y"))


def evaluate_stored(store: EvaluationStore, version: str, runs: DataFrame, datasets: DataFrame, cases: DataFrame,
                    expected: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, spaces: DataFrame,
                    answer: Column | None = None, latency: Column | None = None) -> DataFrame:
    """Case results of all runs, as ``evaluate.evaluate`` gives them; only pairs that ``version`` lacks are searched.

    ``version`` names the state of chunks, vectors, documents and spaces, and the way answers are made. Pairs with
    equal keys are searched once. Rejected queries are error rows and are not stored, since a space may come back.
    """
    judged = pin(retrieve.judge(evaluate.run_queries(runs, datasets, cases), spaces), "eval-queries")
    expected = pin(expected.select("case_id", "chunk_id").distinct(), "eval-expected")
    keyed = pin(_keys(judged, expected), "eval-keys")
    known = store.read(version)
    lacking = keyed.groupBy("key").agg(F.min("query_id").alias("query_id")).join(known.select("key"), "key", "left_anti")
    new = pin(keyed.drop("key").join(lacking, "query_id"), "eval-new")
    if not new.isEmpty():
        hits = retrieve.search_valid(new, chunks, vectors, documents, retrieve.measure(new))
        results = evaluate.case_results(new, hits, expected, answer)
        store.add(version, results.join(new.select("run_id", "case_id", "key"), ["run_id", "case_id"]))
        known = store.read(version)
    told = (latency if latency is not None else F.lit(None)).cast("long").alias("latency_ms")
    found = keyed.join(known, "key").select(
        "run_id", "case_id", F.col("query").alias("question"), *_RESULT, told, F.lit(None).cast("string").alias("error_message"))
    wrong = judged.filter(F.col("error").isNotNull())
    failed = evaluate.case_results(wrong, _no_hits(wrong), expected, answer, latency=latency)
    return found.unionByName(failed)


def _no_hits(judged: DataFrame) -> DataFrame:
    kind = judged.schema["query_id"].dataType.simpleString()
    return judged.sparkSession.createDataFrame([], f"query_id {kind}, rank int, chunk_id long, content string")
