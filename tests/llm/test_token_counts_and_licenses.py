import pytest
from pyspark.sql import functions as F

from kbspark.llm import licenses, token_counts
from tests.llm.samples import awkward, documents, prose

VERSIONS = {"bpe": "/opt/tokenizers/byte_bpe_50k.tiktoken"}


def test_pieces_do_not_change_counts(monkeypatch):
    texts = [text for _, text in awkward() + prose(1, 20) if text] + ["a  b   c\n\n d é. " * 50, " " * 300, "x" * 300]
    encoder = token_counts._encoder(VERSIONS["bpe"])
    whole = [len(encoder.encode_ordinary(text)) for text in texts]
    monkeypatch.setattr(token_counts, "PIECE", 40)
    assert [token_counts.count_tokens(text, VERSIONS["bpe"]) for text in texts] == whole


def slow_totals(rows):
    encoder, out = token_counts._encoder(VERSIONS["bpe"]), {}
    for row in rows:
        docs, tokens = out.get((row["source"], row["lang"]), (0, 0))
        out[row["source"], row["lang"]] = docs + 1, tokens + len(encoder.encode_ordinary(row["text"] or ""))
    return out


def totals(rollup):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_signed_changes(spark, tmp_path):
    docs = documents(spark, [row for row in prose(1, 60) + awkward() if row[0] is not None])
    rollup = token_counts.Rollup(spark, str(tmp_path))
    assert totals(rollup) == {}
    counted = token_counts.per_document(docs, VERSIONS)
    assert rollup.commit("one", token_counts.changes(None, counted))
    before = slow_totals(docs.collect())
    assert totals(rollup) == before
    assert not rollup.commit("one", token_counts.changes(None, counted))
    assert totals(rollup) == before
    revised = docs.filter("doc_id BETWEEN 10 AND 20").withColumn("text", F.lit("short"))
    gone = token_counts.counts_of(counted, docs.filter("doc_id BETWEEN 10 AND 30").select("doc_id"))
    assert rollup.commit("two", token_counts.changes(gone, token_counts.per_document(revised, VERSIONS)))
    left = docs.filter("doc_id < 10 OR doc_id > 30").collect() + revised.collect()
    assert totals(rollup) == slow_totals(left)
    assert rollup.commit("three", token_counts.changes(token_counts.per_document(revised, VERSIONS), None))
    assert totals(rollup) == slow_totals(docs.filter("doc_id < 10 OR doc_id > 30").collect())
    assert rollup.committed() == ["one", "three", "two"]


def test_uncommitted_changes_do_not_count(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path))
    counted = token_counts.changes(None, token_counts.per_document(documents(spark, prose(2, 5)), VERSIONS))
    counted.write.parquet(f"{tmp_path}/changes/cut-off")
    assert totals(rollup) == {}
    assert rollup.commit("cut-off", counted)
    assert sum(n for n, _ in totals(rollup).values()) == 5
    with pytest.raises(ValueError):
        rollup.commit("../elsewhere", counted)


def slow_matches(text, similarity):
    out = []
    for line, one in enumerate((text or "").split("\n") if text is not None else []):
        own = set(licenses.bigrams_of(licenses.normalised(one)))
        for name, notice in licenses.TEMPLATES.items():
            other = set(licenses.bigrams_of(licenses.normalised(notice)))
            dice = 2 * len(own & other) / (len(own) + len(other))
            if own and dice >= similarity - 1e-12:
                out.append((line, name, dice))
    return out


@pytest.mark.parametrize("similarity", [.3, .8, 1.0])
def test_matches_are_those_of_brute_force(spark, similarity):
    notices = list(licenses.TEMPLATES.values())
    rows = awkward() + [(100 + n, f"A line.\n{notice}\n\nand {notice.upper()} more words here\r\n{notice[:-9]}")
                        for n, notice in enumerate(notices)] + [(200, "rights"), (201, "all rights reserved all rights reserved")]
    wanted = sorted(((key, *one) for key, text in rows for one in slow_matches(text, similarity)), key=repr)
    found = licenses.license_lines(documents(spark, rows), similarity=similarity)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == wanted
    assert "Python" not in found._jdf.queryExecution().toString()


def test_odd_templates(spark):
    docs = documents(spark, [(1, "word"), (2, "two words")])
    found = licenses.license_lines(docs, {"none": "...", "one": "Word!", "two": "two words"}).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(1, "one"), (2, "two")}
    assert licenses.license_lines(docs, {}).collect() == []
    assert licenses.license_lines(documents(spark, [])).collect() == []


def one_group(spark, n, tokens):
    return spark.createDataFrame([("a", None, "bpe", n, tokens)], token_counts.CHANGES)


def test_totals_are_kept(spark, tmp_path):
    """Totals read one base and a few batches; merged batches do not count again, nor when their markers come back."""
    rollup = token_counts.Rollup(spark, str(tmp_path), compact_every=3)
    for n in range(1, 9):
        assert rollup.commit(f"batch-{n}", one_group(spark, 1, n))
        assert totals(rollup) == {("a", None): (n, n * (n + 1) // 2)}
        assert not rollup.commit(f"batch-{n}", one_group(spark, 1, n))
    assert sorted(path.name for path in (tmp_path / "base").glob("0*")) == ["000000000001", "000000000002"]
    assert len(list((tmp_path / "open").glob("b*"))) == 2 and len(rollup.committed()) == 8
    # A writer that had looked before the batch was closed sets its marker late.
    (tmp_path / "closed" / "batch-1").rename(tmp_path / "open" / "batch-1")
    (tmp_path / "closed" / "batch-1").mkdir()
    assert totals(rollup) == {("a", None): (8, 36)}
    rollup.compact()
    assert totals(rollup) == {("a", None): (8, 36)}
    assert rollup.commit("gone", one_group(spark, -8, -36)) and totals(rollup) == {}


def test_a_merge_that_stops_half_way_does_not_count_twice(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path), compact_every=100)
    for n in range(3):
        rollup.commit(f"b{n}", one_group(spark, 1, 5))
    moved = token_counts.Rollup._moved
    rollup._moved = lambda source, target: moved(rollup, source, target) if target.startswith("base") else False
    rollup.compact()
    del rollup._moved
    assert len(list((tmp_path / "open").glob("b*"))) == 3 and totals(rollup) == {("a", None): (3, 15)}
    rollup.commit("b3", one_group(spark, 1, 5))
    rollup.compact()
    assert totals(rollup) == {("a", None): (4, 20)} and not list((tmp_path / "open").glob("b*"))


def test_counts_of_no_documents(spark, tmp_path):
    none = token_counts.per_document(documents(spark, []), VERSIONS)
    rollup = token_counts.Rollup(spark, str(tmp_path))
    assert rollup.commit("empty", token_counts.changes(None, none)) and totals(rollup) == {}
    assert not rollup.commit("empty", token_counts.changes(None, none))
