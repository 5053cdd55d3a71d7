"""Tables on disk and streams."""

import datetime

import pytest

from pyspark.sql import functions as F, types as T

from kbspark.operators import ingest, listing
from kbspark.operators.vectorize import finished
from kbspark.plans.catalog import QUERIES
from kbspark.schemas import TABLES
from kbspark.sources.tables import read_table, write_table
from kbspark.sources.testdata import KnowledgeBase
from kbspark.streaming import ingest as stream_ingest, rollup
from tests import models

SF = "/root/testdata/sf0.001"


def test_tables_round_trip(spark, tmp_path):
    kb = KnowledgeBase(spark, SF)
    built = {"kb_space": kb.spaces, "kb_document": kb.documents, "kb_chunk": kb.chunks, "chunk_vector": kb.vectors,
             "qa_session": kb.sessions, "qa_message": kb.messages, "qa_reference": kb.references,
             "eval_dataset": kb.datasets}
    for name, rows in built.items():
        write_table(rows, str(tmp_path), name)
        back = read_table(spark, str(tmp_path), name)
        assert {f.name: f.dataType for f in back.schema} == {f.name: f.dataType for f in TABLES[name]}
        names = sorted(set(rows.columns) & set(TABLES[name].names))
        typed = rows.select(*[F.col(n).cast(TABLES[name][n].dataType) for n in names])
        assert sorted(map(repr, back.select(*names).collect())) == sorted(map(repr, typed.collect())), name
    chunks = read_table(spark, str(tmp_path), "kb_chunk").filter("space_id = 2 and status = 1").select("id")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(space_id" in plan and "EqualTo(status,1)" in plan
    assert "content" not in plan


def test_document_stream(spark, tmp_path):
    schema = T.StructType().add("id", "long").add("space_id", "long").add("content", "string").add("version", "long")
    texts = {}

    def arrive(n, rows):
        for doc, _, text, version in rows:
            if version >= texts.get(doc, ("", -1))[1]:
                texts[doc] = (text, version)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        documents = stream_ingest.read_documents(spark, f"{tmp_path}/in", schema, files_per_batch=1)
        stream_ingest.start_ingest(documents, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        found = {}
        for row in stream_ingest.current_chunks(spark, f"{tmp_path}/out").orderBy("document_id", "chunk_index").collect():
            found.setdefault(row.document_id, []).append(row.content)
        assert found == {doc: models.chunks(text) for doc, (text, _) in texts.items() if text.strip()}

    arrive(1, [(1, 1, "one " * 300, 1), (2, 1, "two " * 10, 1), (1, 1, "one again " * 100, 2)])
    arrive(2, [(3, 2, "three", 1)])
    run()
    arrive(3, [(1, 1, "one at last", 3), (2, 2, "two later " * 200, 2), (3, 2, "three, late", 0), (4, 1, "  ", 1)])
    run()


def test_a_repeated_batch_leaves_the_same_result(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1, "x" * 700, 1)], "id long, space_id long, content string, version long")
    for _ in range(2):
        stream_ingest.chunk_batch(batch, 0, str(tmp_path))
    assert stream_ingest.current_chunks(spark, str(tmp_path)).count() == 2


def test_changes_are_kept_once_and_never_too_late(spark, tmp_path):
    at = datetime.datetime(2024, 1, 10)

    def arrive(rows):
        spark.createDataFrame(rows, "change_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    # Each file is a batch; the third brings a first event that is days older, and repeats.
    for rows in ([(1, at), (1, at)], [(2, at + datetime.timedelta(days=1)), (1, at)],
                 [(3, at - datetime.timedelta(days=2)), (2, at)]):
        arrive(rows)
    stream = spark.readStream.schema("change_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in")
    for _ in range(2):
        stream_ingest.start_changes(stream, ["change_id"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert sorted(row.change_id for row in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
        arrive([(3, at), (1, at)])


def test_keyed_changes_read_only_their_own_batch(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, "change_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("change_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stream_ingest.start_keyed_changes(stream, ["change_id"], f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        return query.recentProgress

    provider = spark.conf.get(stream_ingest._STATE_STORE)
    for rows in ([(1, "a"), (1, "a")], [(2, "b"), (1, "c")], [(None, "n"), (None, "n")]):
        arrive(rows)
    assert [one["numInputRows"] for one in run() if one["numInputRows"]] == [2, 2, 2]
    # A later start goes on from the stored keys; what earlier batches wrote is not needed any more.
    arrive([(3, "d"), (2, "e"), (None, "n")])
    progress = [one for one in run() if one["numInputRows"]]
    assert [one["numInputRows"] for one in progress] == [3]
    assert "RocksDB" in repr(progress[-1]["stateOperators"]) or "rocksdb" in repr(progress[-1]["stateOperators"])
    assert sorted(((r.change_id, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == sorted(
        [(1, 0), (2, 1), (None, 2), (3, 3)], key=repr)
    assert spark.conf.get(stream_ingest._STATE_STORE) == provider


def test_merged_rollup_reads_few_folders(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(8).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    rollup.start_rollup(KnowledgeBase.outcomes_of(stream), out, f"{tmp_path}/state", compact_every=3).awaitTermination()
    last, snapshot, batches = rollup._parts(spark, out)
    assert last == 5 and len(snapshot) == 1 and [b.rsplit("=", 1)[1] for b in batches] == ["6", "7"]
    # Only what the snapshot before does not hold is left.
    assert sorted(rollup._folders(spark, f"{out}/batch_id=*")) == [3, 4, 5, 6, 7]
    whole = finished(rollup.outcome_counts(KnowledgeBase.outcomes_of(events)))

    def told():
        return sorted(map(repr, rollup.current_tasks(spark, out).select(*whole.columns).collect()))

    wanted = sorted(map(repr, whole.collect()))
    assert told() == wanted
    # A snapshot that was not completed does not count, and writing one again changes nothing.
    spark.range(1).write.parquet(f"{out}/_snapshots/upto=7")
    (tmp_path / "out/_snapshots/upto=7/_SUCCESS").unlink()
    assert told() == wanted
    for _ in range(2):
        rollup.compact(spark, out, 7)
        assert told() == wanted


def test_a_batch_run_again_keeps_the_same_changes(spark, tmp_path):
    first, second = [spark.createDataFrame(rows, "change_id long") for rows in ([(1,), (2,)], [(2,), (3,)])]
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        stream_ingest.keep_first(batch, number, ["change_id"], str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path)).collect())) == [(1, 0), (2, 0), (3, 1)]


def test_a_version_sent_twice_is_chunked_once(spark, tmp_path):
    row = (1, 1, "x" * 700, 1)
    batch = spark.createDataFrame([row, row, (1, 1, "old", 0)], "id long, space_id long, content string, version long")
    stream_ingest.chunk_batch(batch, 0, str(tmp_path))
    assert stream_ingest.current_chunks(spark, str(tmp_path)).count() == 2


def test_versions_have_chunk_ids_of_their_own(spark, tmp_path):
    schema = "id long, space_id long, content string, version long"
    for number, content in ((0, "x" * 700), (1, "y" * 1200), (1, "y" * 1200), (2, "z")):
        batch = spark.createDataFrame([(1, 1, content, number), (2 + number, 1, content, 0)], schema)
        stream_ingest.chunk_batch(batch, number, str(tmp_path))
    ids = [row.id for row in spark.read.parquet(f"{tmp_path}/chunks").collect()]
    assert len(ids) == len(set(ids)) == 2 * (2 + 3 + 1)
    assert [row.content for row in stream_ingest.current_chunks(spark, str(tmp_path)).filter("document_id = 1").collect()] == ["z"]


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from kbspark.sources import folders

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master, applicationId = "spark://somewhere", "cluster"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        folders.shared_folder(Cluster, "some")


def test_rollup_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rollup.start_rollup(KnowledgeBase.outcomes_of(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    told = rollup.current_tasks(spark, f"{tmp_path}/out")
    whole = finished(rollup.outcome_counts(KnowledgeBase.outcomes_of(events)))
    assert spark.read.parquet(f"{tmp_path}/out").select("batch_id").distinct().count() == 4
    assert sorted(map(repr, told.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_chunk_stream_uses_the_batch_operator(spark):
    assert ingest.chunk_documents(
        spark.createDataFrame([(1, 1, "a")], "id long, space_id long, content string")).count() == 1


def test_repeated_vectors_do_not_double_chunks(spark):
    from kbspark.operators import vectorize

    chunks = spark.createDataFrame(
        [(n, 1, 1, n, "text", 4, 0, None, 1) for n in range(3)],
        "id long, document_id long, space_id long, chunk_index int, content string, char_count int, "
        "embedding_status int, vector_id string, status int")
    documents = spark.createDataFrame([(1, 1)], "id long, status int")
    vectors = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, None), (1, None)], "id long, embedding array<float>")
    assert sorted((r.id, r.embedding_status) for r in vectorize.mark_outcomes(chunks, documents, vectors).collect()) == [
        (0, 1), (1, 1), (2, 2)]
    row = vectorize.rollup(chunks, documents, vectors).first()
    assert (row.total_chunk_count, row.success_count, row.failed_count) == (3, 2, 1)
    assert sorted((r.id, r.embedding) for r in vectorize.attach_vectors(chunks, vectors).collect()) == [
        (0, [1.0]), (1, [1.0]), (2, None)]


@pytest.mark.parametrize("bound", ["1000000", "200"])
def test_children_of_given_parents(spark, tmp_path, bound):
    """Equal however the ids are sent; directories of other spaces and files of other ids are pruned."""
    sessions = spark.range(40).selectExpr("id", "id % 4 space_id", "cast(id % 5 > 0 as int) status")
    messages = spark.range(400).selectExpr("id", "id % 40 session_id", "id % 4 space_id", "'user' role", "'text' content",
                                           "timestamp_ntz'2024-01-01' created_at")
    write_table(messages, str(tmp_path), "qa_message")
    stored = read_table(spark, str(tmp_path), "qa_message")
    given = spark.createDataFrame([(n,) for n in (2, 6, 6, 10, 14, 22, 99, None)], "id long")
    spark.conf.set("kbspark.maxBroadcastBytes", bound)
    try:
        found = listing.messages_of(stored, sessions, given)
        assert [(row.session_id, row.id) for row in found.collect()] == [
            (s, s + 40 * n) for s in (2, 6, 14, 22) for n in range(10)]
        if bound == "1000000":
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "dynamicpruning" in plan and "GreaterThanOrEqual(session_id,2)" in plan
        nothing = listing.messages_of(stored, sessions, given.filter("id = 99"))
        assert nothing.collect() == []
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    assert {row.id for row in listing.unknown(sessions, given.filter("id is not null"), "session not found").collect()} == {10, 99}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_in_one_file_or_many_is_a_stream(spark, tmp_path, files):
    rows = [(n, f"text {n} " * 90, "en", "src1", 7) for n in range(9)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given.repartition(files, "doc_id").write.parquet(str(tmp_path / "written"))
    if files > 1:
        (tmp_path / "documents.parquet").symlink_to(tmp_path / "written")
    else:
        (tmp_path / "documents.parquet").write_bytes(next((tmp_path / "written").glob("part-*.parquet")).read_bytes())
    found = QUERIES["stream_document_chunks"](spark, str(tmp_path))
    assert sorted(row.document_id for row in found.filter("chunk_index = 0").collect()) == list(range(9))


def test_texts_are_not_shuffled_for_their_status(spark, tmp_path):
    """Chunks get the status of their document, also where ids repeat or labels lack one, without a shuffle of texts."""
    ids = [*range(12), 3, None]
    spark.createDataFrame([(n, f"text {n} {at} " * 90, "en", "src1", 7) for at, n in enumerate(ids)],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(64).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 1), (3, 0, 1), (5, 1, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kb = KnowledgeBase(spark, str(tmp_path))
        plan = kb.chunks._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        heads = sorted((row.document_id, row.status) for row in kb.chunks.filter("chunk_index = 0").collect())
        # Two documents with one id: the chunks of each belong to both.
        assert heads == sorted((n, 0 if n in (3, 5) else 1) for n in [*range(12), 3, 3, 3])
        assert sorted(map(repr, kb.documents.select("id", "status").collect())) == sorted(
            f"Row(id={n}, status={0 if n in (3, 5) else 1})" for n in ids)
        before = sorted(map(repr, kb.chunks.collect()))
        assert sorted(map(repr, kb.pin_chunks().pin_chunks().chunks.collect())) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
