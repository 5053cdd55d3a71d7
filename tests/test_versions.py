"""Versioned tables, feeds committed to them, and recall from their stored grams."""

import datetime
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.functions import gram_lists
from kbspark.operators import contains, feed, gram_index, ingest, retrieve
from kbspark.sources import versions
from kbspark.sources.versions import CommitConflict, Part, Versions

CHANGE = "seq long, op string, id long, space_id long, title string, content string, source_type string, source_uri string"


def documents(spark, rows):
    return ingest.prepare_documents(spark.createDataFrame(
        [(n, space, f"title {n}", text, "SRC", None) for n, space, text in rows],
        "id long, space_id long, title string, content string, source_type string, source_uri string"))


def spaces(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id long, status int")


@pytest.fixture
def store(spark, tmp_path):
    """Documents 0 to 39 in blocks of ten, even ones in space 1 and odd ones in space 2."""
    store = Versions(spark, f"{tmp_path}/kb", block_documents=10)
    rows = documents(spark, [(n, 1 + n % 2, f"text of document {n}, " * 40) for n in range(40)])
    assert store.commit(0, {"kb_document": rows, "kb_chunk": ingest.chunk_documents(rows)}) == 1
    return store


def files(root):
    found = {}
    for folder, _, names in os.walk(root):
        found |= {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for name in names if name.startswith("part-")}
    return found


def changes(spark, *rows):
    return spark.createDataFrame([(n, op, key, space, title, text, None, None) for n, (op, key, space, title, text) in enumerate(rows)], CHANGE)


def state(store, version=None):
    return (sorted((r.id, r.space_id, r.title, r.status) for r in store.read("kb_document", version).collect()),
            sorted((r.id, r.document_id, r.space_id, r.content, r.status) for r in store.read("kb_chunk", version).collect()))


def test_a_feed_writes_only_touched_partitions(spark, store):
    before, old = files(store.root), store.read("kb_document", 1)
    at = datetime.datetime(2024, 5, 1)
    done = feed.commit_changes(store, changes(
        spark, ("update", 4, 2, "moved", "new text"), ("delete", 33, None, None, None), ("create", 95, 1, "new", "first text"),
        ("update", 77, None, "x", "y")), spaces(spark), at=F.lit(at))
    assert done.version == store.current() == 2
    # The space that the document left is rewritten as well as the one it moved to.
    assert set(done.touched) == {Part(1, 0), Part(2, 0), Part(2, 3), Part(1, 9)}
    after = files(store.root)
    assert {path: time for path, time in after.items() if path in before} == before
    new = {path for path in after if path not in before and "/versions/" not in path}
    assert {path.split("/block=")[1].split("/")[0] for path in new} == {"0", "3", "9"}
    for name in ("kb_document", "kb_chunk"):
        first, second = store.parts(1)[name], store.parts(2)[name]
        assert {part for part in second if second[part] != first.get(part)} == set(done.touched)
    rows = {r.id: r for r in store.read("kb_document").collect()}
    assert len(rows) == 41 and rows[4].space_id == 2 and rows[4].title == "moved" and rows[33].status == 0
    assert rows[95].created_at == rows[95].updated_at == rows[4].updated_at == rows[33].updated_at == at
    assert rows[4].created_at is None or rows[4].created_at == at
    assert rows[5].updated_at is None
    assert [(r.op, r.id, r.reason) for r in done.rejects.collect()] == [("update", 77, "document not found")]
    # Readers of the version before still see it.
    assert {r.id: r.space_id for r in old.collect()}[4] == 1


def test_a_feed_equals_the_change_of_whole_tables(spark, store):
    chance = random.Random(4)
    rows = [(chance.choice(["update", "update", "delete", "create"]), chance.randint(0, 50), chance.choice([None, 1, 2, 3]),
             chance.choice(["t", "u", " "]), "word " * chance.randint(0, 300)) for _ in range(60)]
    for part in (rows[:30], rows[30:]):
        some, base = changes(spark, *part), store.current()
        whole = ingest.apply_document_changes(store.read("kb_document", base), store.read("kb_chunk", base), some, spaces(spark))
        wanted = (sorted((r.id, r.space_id, r.title, r.status) for r in whole.documents.collect()),
                  sorted((r.id, r.document_id, r.space_id, r.content, r.status) for r in whole.chunks.collect()))
        done = feed.commit_changes(store, some, spaces(spark))
        assert state(store) == wanted
        assert sorted(map(tuple, done.rejects.collect()), key=repr) == sorted(map(tuple, whole.rejects.collect()), key=repr)


def test_rules_of_form_come_first(spark, store):
    done = feed.commit_changes(store, spark.createDataFrame([
        (1, "update", 2, 1, " ", "\n", None, None), (2, "create", 60, 1, "t" * 400, "text", None, None),
        (3, "upsert", 4, 1, "t", "text", None, None), (4, None, None, 1, "t", "text", None, None),
        (5, "delete", None, None, None, None, None, None), (6, "update", 2, 1, "t", " ", None, None),
        (7, "update", 2, 1, "t", "text", "s" * 65, None), (8, "update", 60, 1, "t", "text", None, None),
        (9, "update", 2, 3, "t", "text", None, None), (10, "create", 61, None, "t", "text", None, None)], CHANGE), spaces(spark))
    assert {r.seq: r.reason for r in done.rejects.collect()} == {
        1: "title blank", 2: "title longer than 255", 3: "unknown operation", 4: "unknown operation", 5: "id missing",
        6: "content blank", 7: "source_type longer than 64", 8: "document not found", 9: "space not found", 10: "space not found"}
    assert done.version == store.current() == 1 and not done.touched


def test_of_two_writers_one_starts_again(spark, store):
    rows = store.read("kb_chunk", 1, [Part(1, 0)]).withColumn("status", F.lit(0))
    assert store.commit(1, {"kb_chunk": rows}, [Part(1, 0)]) == 2
    before = state(store)
    with pytest.raises(CommitConflict):
        store.commit(1, {"kb_chunk": rows.limit(1)}, [Part(1, 0)])
    assert store.current() == 2 and state(store) == before
    with pytest.raises(ValueError):
        store.commit(2, {"kb_chunk": rows}, [Part(2, 0)])
    assert state(store) == before
    # What the failed writers left, and the version before, goes.
    assert store.clean() >= 2
    assert state(store) == before and len(files(store.root)) == len(
        {folder for known in store.parts(2).values() for folder in known.values()}) + 1


def test_outcomes_write_only_partitions_with_pending_chunks(spark, store):
    done = store.read("kb_chunk", 1).withColumn("embedding_status", F.when(F.col("document_id") == 13, 0).otherwise(1))
    store.commit(1, {"kb_chunk": done})
    vectors = store.read("kb_chunk", 2).filter("document_id = 13 AND chunk_index = 0").select("id", F.array(F.lit(1.0)).alias("embedding"))
    marked = feed.commit_outcomes(store, vectors)
    assert marked.touched == [Part(2, 1)]
    found = {(r.document_id, r.chunk_index): r.embedding_status for r in store.read("kb_chunk").collect()}
    assert found[13, 0] == 1 and found[13, 1] == 2 and set(found.values()) == {1, 2}
    assert feed.commit_outcomes(store, vectors).version == marked.version


def test_nothing_is_read_before_the_first_version(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/none")
    assert store.current() == 0 and store.read("kb_chunk").count() == 0


def wanted_ids(texts, space, term, most):
    ids = sorted(n for n, home, text in texts if home == space and term in text.lower())
    return [(space, term, n) for n in ids[:most]]


@pytest.mark.parametrize("most", [None, 3])
def test_recall_from_grams(spark, store, most):
    chance = random.Random(3)
    letters = "abC \n漢é"
    word = lambda low, high: "".join(chance.choices(letters, k=chance.randint(low, high)))
    texts = [(n, 1 + n % 2, "x" + word(0, 90) + "y") for n in range(200)]
    chunks = spark.createDataFrame([(n, n // 4, 1 + n // 4 % 2, n % 4, text, 1, 1) for n, _, text in texts],
                                   "id long, document_id long, space_id long, chunk_index int, content string, embedding_status int, status int")
    texts = [(n, 1 + n // 4 % 2, text) for n, _, text in texts]
    store.commit(1, {"kb_chunk": chunks})
    gram_index.build(store)
    terms = sorted({(chance.randint(1, 3), word(1, size).lower()) for size in (1, 2, 3, 4, 5, 9) for _ in range(12)}
                   | {(1, texts[0][2][3:40].lower()), (1, texts[8][2].lower()), (2, "y"), (2, "x")})
    asked = spark.createDataFrame(terms, "space_id long, term string")
    found = gram_index.recall(store, retrieve.searchable)(asked, most)
    wanted = sorted(row for space, term in terms for row in wanted_ids(texts, space, term, most))
    assert sorted((r.space_id, r.term, r.chunk_id) for r in found.collect()) == wanted


def test_a_feed_keeps_grams_up(spark, store, monkeypatch):
    gram_index.build(store)
    feed.commit_changes(store, changes(spark, ("update", 4, 2, "moved", "A Quite Unusual text"), ("delete", 33, None, None, None)),
                        spaces(spark))
    chunks = store.read("kb_chunk").withColumn("embedding_status", F.lit(1))
    store.commit(store.current(), {"kb_chunk": chunks})
    reads, read = [], Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, name, version=None, only=None: (reads.append((name, only)), read(self, name, version, only))[1])
    terms = [(1, "unusual"), (2, "unusual"), (2, "document 33,"), (1, "document 4,"), (1, "document 6,")]
    found = gram_index.recall(store, retrieve.searchable)(spark.createDataFrame(terms, "space_id long, term string"), None)
    assert {(r.space_id, r.term) for r in found.collect()} == {(2, "unusual"), (1, "document 6,")}
    # Texts are read only where a candidate lies.
    assert [set(only) for name, only in reads if name == "kb_chunk" and only is not None] == [{Part(2, 0), Part(2, 3), Part(1, 0)}]


def test_grams_of_a_text(spark):
    row = spark.createDataFrame([("abcde",), ("ab",), ("",), (None,)], "t string").select(
        F.sort_array(gram_index._grams(F.col("t"))), contains.full_grams(F.col("t"))).collect()
    assert row[0][0] == ["abcd", "bcde", "cde", "de", "e"] and row[1][0] == ["ab", "b"] and row[2][0] == []


def test_partitions_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Blocks of a larger table are larger; what is read and committed stays the same, also by another store."""
    monkeypatch.setattr(versions, "MAX_PARTS", 8)
    rows = documents(spark, [(n, 1 + n % 2, f"text of document {n}, " * 40) for n in range(160)])
    made = Versions(spark, f"{tmp_path}/kb", block_documents=10)
    made.commit(0, {"kb_document": rows, "kb_chunk": ingest.chunk_documents(rows)})
    assert {name: len(known) for name, known in made.parts(1).items()} == {"kb_document": 8, "kb_chunk": 8}
    other = Versions(spark, f"{tmp_path}/kb", block_documents=10)
    assert other.block_documents == made.block_documents == 40
    feed.commit_changes(other, changes(spark, ("update", 44, 2, "moved", "new text")), spaces(spark))
    assert {name: len(known) for name, known in made.parts(2).items()} == {"kb_document": 8, "kb_chunk": 8}
    texts = {row.id: row.content for row in made.read("kb_document").collect()}
    assert texts == {n: "new text" if n == 44 else f"text of document {n}, " * 40 for n in range(160)}


def test_grams_are_listed_without_a_row_per_text(spark, monkeypatch):
    chance = random.Random(5)
    texts = [(n % 90, n % 3 if n % 7 else None, n % 2, "".join(chance.choices("abé漢\x00😀", k=chance.randint(0, 30)))) for n in range(100)]
    rows = spark.createDataFrame([*texts, (200, 1, 0, None)], "id long, space_id long, block long, content string").repartition(3)
    wanted = {}
    for n, space, block, text in texts:
        for at in range(len(text)):
            wanted.setdefault((space, block * 10, text[at:at + 4]), set()).add(n)
    for letters, most in ((1 << 20, 65535), (40, 65535), (1 << 20, 2)):
        monkeypatch.setattr(gram_lists, "BLOCK_LETTERS", letters)
        monkeypatch.setattr(gram_lists, "_MOST", most)
        by_space = {}
        for space, block in {(space, block) for _, space, block, _ in texts}:
            own = [one for one in texts if one[1:3] == (space, block)]
            for grams, found in gram_lists.lists(np.array([one[0] for one in own]), [one[3] for one in own]):
                assert len(set(grams)) == len(grams)
                for gram, ids in zip(grams, found.to_pylist(), strict=True):
                    assert ids == sorted(set(ids))
                    by_space.setdefault((space, block * 10, gram), set()).update(ids)
        assert by_space == wanted
    made = gram_index.grams_of(rows, 10)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    found = {}
    for row in made.collect():
        assert row.chunks == len(row.chunk_ids)
        found.setdefault((row.space_id, row.document_id, row.gram), set()).update(row.chunk_ids)
    assert found == wanted


def test_short_terms_whose_lowest_chunks_are_not_searchable(spark, store, monkeypatch):
    monkeypatch.setattr(gram_index, "FIRST_IDS", 3)
    chunks = spark.createDataFrame([(n, n // 4, 1, n % 4, f"xy z{n % 5}", 1, int(n >= 10 or n % 5 == 1)) for n in range(40)],
                                   "id long, document_id long, space_id long, chunk_index int, content string, embedding_status int, status int")
    store.commit(1, {"kb_chunk": chunks})
    gram_index.build(store)
    asked = spark.createDataFrame([(1, "xy"), (1, "z1"), (1, "q"), (2, "xy")], "space_id long, term string")
    found = gram_index.recall(store, retrieve.searchable)(asked, 2)
    assert sorted((r.term, r.chunk_id) for r in found.collect()) == [("xy", 1), ("xy", 6), ("z1", 1), ("z1", 6)]


def test_lists_are_packed():
    chance = random.Random(7)
    for _ in range(100):
        lists = [sorted({chance.choice((chance.randint(-5, 5), chance.randint(0, 30) * 1_000_000 + chance.randint(0, 400),
                                        chance.randint(-1 << 62, 1 << 62))) for _ in range(chance.randint(1, 9))}) for _ in range(chance.randint(1, 9))]
        lowest, held = min(map(min, lists)), pa.array(lists, pa.list_(pa.int64()))
        packed = gram_lists.packed(held, lowest)
        for first, last in ((0, len(lists)), (1, len(lists)), (0, len(lists) - 1)):
            part = packed[first:last]
            assert gram_lists.packed(held[first:last], lowest).equals(part)
            ids, sizes = gram_lists.unpacked(part, np.full(len(part), lowest))
            assert ids.tolist() == [one for own in lists[first:last] for one in own] and sizes.tolist() == [len(own) for own in lists[first:last]]
    near = pa.array([[document * 1_000_000 + n for document in range(90) for n in range(0, 20, 3)]], pa.list_(pa.int64()))
    assert gram_lists.packed(near, 0).nbytes < 1.3 * len(near[0])


def test_the_gram_table_is_written_without_a_shuffle_and_no_shuffle_is_left(spark, tmp_path):
    """The disk held a shuffle of all lists beside the table, and shuffles of earlier tables until garbage was collected."""
    context, environment = spark.sparkContext._jsc.sc(), spark._jvm.org.apache.spark.SparkEnv.get()

    def shuffle_files():
        found = environment.blockManager().diskBlockManager().getAllFiles()
        return {found.apply(n).getName() for n in range(found.size()) if found.apply(n).getName().startswith("shuffle_")}

    spark._jvm.System.gc()
    rows = documents(spark, [(n, 1 + n % 2, f"text of document {n}, " * 40) for n in range(160)])
    made = Versions(spark, f"{tmp_path}/kb", block_documents=10)
    first = context.newShuffleId()
    made.commit(0, {"kb_document": rows, "kb_chunk": ingest.chunk_documents(rows)})
    assert (before := context.newShuffleId()) > first + 1
    gram_index.build(made)
    assert context.newShuffleId() == before + 1
    until = time.time() + 20
    while (left := {name for name in shuffle_files() if first < int(name.split("_")[1]) < before}) and time.time() < until:
        time.sleep(0.2)
    # The sizes of blocks are counted in a query of their own, whose few numbers may stay.
    assert len({name.split("_")[1] for name in left}) <= 1
    kept = made.read("chunk_gram").agg(F.sum("chunks"), F.sum(F.octet_length("chunk_ids"))).first()
    assert kept[1] < 3 * kept[0]


def test_candidates_are_read_in_shares(spark, store, monkeypatch):
    """Grams of "abcdef" that lie apart make candidates; of many only some have the term, the lowest or the highest."""
    monkeypatch.setattr(gram_index, "FIRST_TIMES", 1)
    monkeypatch.setattr(gram_index, "SHARES", (1 / 64, 1 / 8))
    text = {0: "abcd bcde cdef", 1: "xx abcdef", 2: "cdefgh abcdef"}
    which = lambda n, space: 0 if space == 1 and n % 400 < 380 or space == 2 and n % 400 > 8 else 1 + n % 2
    chunks = [(n * 1_000_000 + k, n, 1 + n % 2, k, text[which(n // 2 * 2 + k, 1 + n % 2)], 1, int(n != 396)) for n in range(400) for k in range(2)]
    store.commit(1, {"kb_chunk": spark.createDataFrame(
        chunks, "id long, document_id long, space_id long, chunk_index int, content string, embedding_status int, status int")})
    gram_index.build(store)
    reads, pinned = [], gram_index.pin
    monkeypatch.setattr(gram_index, "pin", lambda rows, name: (pinned(rows, name), reads.append(name))[0])
    terms = [(space, term) for space in (1, 2, 3) for term in ("abcdef", "cdefgh", "bcdefg", "abcd bcde")]
    found = gram_index.recall(store, retrieve.searchable)(spark.createDataFrame(terms, "space_id long, term string"), 4)
    wanted = []
    for space, term in terms:
        ids = sorted(n for n, _, home, _, content, _, status in chunks if home == space and status and term in content)
        wanted += [(space, term, n) for n in ids[:4]]
    assert sorted((r.space_id, r.term, r.chunk_id) for r in found.collect()) == sorted(wanted) and len(wanted) > 15
    assert reads.count("some-found") == 3
