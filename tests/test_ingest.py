import random

import pytest

from kbspark.operators import ingest, integrity
from tests import models

CHANGE = ("seq long, op string, id long, space_id long, title string, content string, source_type string, "
          "source_uri string")
DOCUMENT = ("id long, space_id long, title string, content string, source_type string, source_uri string, "
            "status int")


def apply_one_by_one(documents, spaces, changes):
    """The feed applied in order, as the rules say."""
    state, rejects, rebuilt = {row[0]: list(row) for row in documents}, [], set()
    for seq, op, doc, space, title, content, kind, uri in sorted(changes):
        alive = doc in state and state[doc][6] == 1
        if op != "delete" and not content.strip():
            rejects.append((seq, "content blank"))
        elif op in ("create", "update") and (space is not None or op == "create") and spaces.get(space) != 1:
            rejects.append((seq, "space not found"))
        elif op == "create":
            if doc in state:
                rejects.append((seq, "document exists"))
            else:
                state[doc] = [doc, space, title, content, kind.strip() and kind or "MANUAL", uri, 1]
                rebuilt.add(doc)
        elif not alive:
            rejects.append((seq, "document not found"))
        elif op == "delete":
            state[doc][6] = 0
        else:
            old = state[doc]
            state[doc] = [doc, old[1] if space is None else space, title, content, kind if kind.strip() else old[4],
                          uri, 1]
            rebuilt.add(doc)
    return state, rejects, rebuilt


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_feed(spark, seed):
    rng = random.Random(seed)
    spaces = {1: 1, 2: 1, 3: 0}
    documents = [(n, rng.randint(1, 2), f"t{n}", f"old {n} " * 90, "WIKI", None, int(n % 4 != 0)) for n in range(1, 13)]
    changes = []
    for seq in range(120):
        # Half of the changes name one document; new ids are created first, sometimes after a stray change.
        doc = rng.choice([1, 2, 3, rng.randint(1, 20)])
        op = rng.choice(["update"] * 5 + ["delete"] + (["create"] * 4 if doc > 12 else []))
        changes.append((seq, op, doc, rng.choice([None, 1, 2, 3, 7]), f"title {seq}", f"text {seq} " * rng.randint(0, 99),
                        rng.choice(["", " ", f"K{seq}"]), f"u{seq}"))
    before = spark.createDataFrame(documents, DOCUMENT)
    chunks = ingest.chunk_documents(before).withColumnRenamed("status", "s").withColumn("status", ingest.F.lit(1)).drop("s")
    result = ingest.apply_document_changes(
        before, chunks, spark.createDataFrame(changes, CHANGE).repartition(4),
        spark.createDataFrame(list(spaces.items()), "id long, status int"))
    state, rejects, rebuilt = apply_one_by_one(documents, spaces, changes)
    assert sorted((row.seq, row.reason) for row in result.rejects.collect()) == rejects
    assert {row.id: list(row)[:7] for row in result.documents.collect()} == state
    found = {}
    for row in result.chunks.orderBy("document_id", "chunk_index").collect():
        found.setdefault(row.document_id, []).append((row.content, row.space_id, row.status))
        assert row.embedding_status == 0 and row.vector_id is None
    deleted = {doc for doc, row in state.items() if row[6] == 0}
    for doc, row in state.items():
        was_deleted_before = any(d[0] == doc and d[6] == 0 for d in documents)
        status = 0 if doc in deleted and not was_deleted_before else 1
        assert found.get(doc, []) == [(piece, row[1], status) for piece in models.chunks(row[3])], doc


def test_ids_are_not_used_again(spark):
    documents = spark.createDataFrame(
        [(1, 1, "t", "x" * 900, "MANUAL", None, 1, "me"), (2, 1, "t", "other", "MANUAL", None, 1, "you")],
        "id long, space_id long, title string, content string, source_type string, source_uri string, status int, owner string")
    chunks, spaces = ingest.chunk_documents(documents), spark.createDataFrame([(1, 1)], "id long, status int")
    used, counts = {row.id for row in chunks.collect()}, []
    for content in ("s", "y" * 900, "z" * 100):
        changes = spark.createDataFrame([(1, "update", 1, None, "t", content, None, None)], CHANGE)
        changed = ingest.apply_document_changes(documents, chunks, changes, spaces)
        documents, chunks = (spark.createDataFrame(rows.collect(), rows.schema) for rows in changed[:2])
        ids = {row.id for row in chunks.filter("document_id = 1").collect()}
        assert not ids & used
        used |= ids
        rows = {row.id: row for row in documents.collect()}
        counts.append(rows[1].chunk_count)
        assert (rows[1].owner, rows[2].owner, rows[2].chunk_count) == ("me", "you", None)
    assert counts == [1, 2, 1]
    # A blank text is refused, and the document keeps what it has.
    changes = spark.createDataFrame([(1, "update", 1, None, "t", " ", None, None)], CHANGE)
    changed = ingest.apply_document_changes(documents, chunks, changes, spaces)
    assert [row.reason for row in changed.rejects.collect()] == ["content blank"]
    assert {row.id for row in changed.chunks.filter("document_id = 1").collect()} == ids


def test_latest_keeps_one_row_per_key(spark):
    rows = spark.range(1000).selectExpr("id % 3 as key", "id as version", "repeat('x', 10) as text")
    newest = ingest.latest(rows, "key", "version")
    assert sorted((row.key, row.version) for row in newest.collect()) == [(0, 999), (1, 997), (2, 998)]
    plan = ingest.latest(rows, "key", "version")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once in every task before the shuffle


def test_spaces(spark):
    spaces = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1), (3, "c", "z", 0)],
                                   "id long, name string, description string, status int")
    requests = spark.createDataFrame(
        [(1, "a", "kept"), (2, "a", "taken"), (4, "c", "free again"), (5, "c", "too late"), (6, "d", None)],
        "id long, name string, description string")
    after, rejects = ingest.upsert_spaces(spaces, requests)
    assert {row.id: row.reason for row in rejects.collect()} == {
        2: "name of an active space", 5: "name of an earlier request"}
    assert sorted(map(tuple, after.collect())) == [
        (1, "a", "kept", 1), (2, "b", "y", 1), (3, "c", "z", 0), (4, "c", "free again", 1), (6, "d", None, 1)]
    documents = spark.createDataFrame([(1, 1, 1), (2, 2, 0)], "id long, space_id long, status int")
    gone = ingest.delete_spaces(spaces, documents, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert {row.id: row.status for row in gone.collect()} == {1: 1, 2: 0, 3: 0}


def test_space_requests_are_judged(spark):
    spaces = spark.createDataFrame([(1, "a", "x", 1, "kept"), (2, "b", "y", 0, "kept")],
                                   "id long, name string, description string, status int, owner string")
    requests = spark.createDataFrame(
        [(1, " ", None), (2, "new", None), (3, "c" * 500, None), (4, "d", None), (4, "e", None), (5, "f", None)],
        "id long, name string, description string")
    after, rejects = ingest.upsert_spaces(spaces, requests)
    assert {(row.id, row.reason.split(" longer")[0]) for row in rejects.collect()} == {
        (1, "name blank"), (2, "space not found"), (3, "name"), (4, "repeated request")}
    assert sorted(map(tuple, after.collect())) == [
        (1, "a", "x", 1, "kept"), (2, "b", "y", 0, "kept"), (5, "f", None, 1, None)]
    documents = spark.createDataFrame([(1, 1)], "space_id long, status int")
    asked = spark.createDataFrame([(1,), (2,), (9,), (9,)], "id long")
    assert {(row.id, row.reason) for row in ingest.space_delete_rejects(spaces, documents, asked).collect()} == {
        (1, "space has active documents"), (2, "space not found"), (9, "space not found")}


def test_field_rules(spark):
    rows = spark.createDataFrame(
        [(1, 1, "ok", "text", "WIKI", None), (2, None, " \t", "", "k" * 65, "u" * 513), (3, 1, "t" * 256, None, None, "u"),
         (4, 1, "t" * 255, "c", "k" * 64, "u" * 512)],
        "id long, space_id long, title string, content string, source_type string, source_uri string")
    broken = sorted(map(tuple, ingest.violations(rows, ingest.document_rules()).collect()))
    assert broken == [
        (2, "content blank"), (2, "source_type longer than 64"), (2, "source_uri longer than 512"),
        (2, "space_id missing"), (2, "title blank"), (3, "content blank"), (3, "title longer than 255")]
    assert sorted(row.id for row in ingest.conforming(rows, ingest.document_rules()).collect()) == [1, 4]
    assert "space_id missing" not in ingest.document_rules(space_required=False)
    named = spark.createDataFrame([(1, " ", None), (2, "n" * 101, "d" * 501), (3, "n" * 100, "d" * 500)],
                                  "id long, name string, description string")
    assert sorted(map(tuple, ingest.violations(named, ingest.space_rules()).collect())) == [
        (1, "name blank"), (2, "description longer than 500"), (2, "name longer than 100")]


def test_integrity(spark):
    def table(*rows, names):
        return spark.createDataFrame(list(rows), names)

    report = integrity.integrity_report({
        "kb_space": table((1, 1), (2, 0), names="id long, status int"),
        "kb_document": table((1, 1, 1), (2, 2, 1), (3, 2, 0), names="id long, space_id long, status int"),
        "kb_chunk": table((1, 1, 1, 1), (2, 1, 2, 1), (3, 3, 2, 1), (4, 3, 2, 0),
                          names="id long, document_id long, space_id long, status int"),
        "qa_session": table((1, 1, 1), names="id long, space_id long, status int"),
        "qa_message": table((1, 1, 1), (2, 1, 2), (3, 9, 1), names="id long, session_id long, space_id long"),
        "eval_run": table((1, 5), names="id long, dataset_id long"),
        "eval_case_result": table((1, 1), (2, 8), names="id long, run_id long")})
    assert sorted(map(tuple, report.collect())) == [
        ("document not found", "kb_chunk", 3), ("document of another space", "kb_chunk", 2),
        ("run not found", "eval_case_result", 2), ("session not found", "qa_message", 3),
        ("session of another space", "qa_message", 2), ("space not found", "kb_document", 2)]
