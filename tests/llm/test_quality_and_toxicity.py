import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import quality, toxicity
from tests.llm.samples import awkward, documents, prose

SF = "/root/testdata/sf0.1"


def test_heuristics():
    fine = "The story of the house and the garden is told in it, and that was all for the day on which we were there."
    assert set(quality.votes(fine.encode())) <= {quality.GOOD, quality.NONE}
    for bad in ("buy### now$$$ cheap%%% " * 20, "LOUD!! WORDS!! " * 30, "again and " * 60, "Home | News | Shop | Help | " * 10):
        assert quality.BAD in quality.votes(bad.encode())
    for empty in (b"", b" \n\t"):
        assert set(quality.votes(empty)) == {quality.NONE}


def test_profile_is_the_same_over_blocks(monkeypatch):
    from kbspark.llm import common

    text = dict(awkward())[6].encode()
    whole = quality.Profile(text)
    monkeypatch.setattr(common, "BLOCK_BYTES", 1000)
    parts = quality.Profile(text)
    for name in ("words", "repeats", "small", "bare", "marked", "distinct"):
        assert getattr(whole, name) == getattr(parts, name), name


def test_expectation_maximisation_finds_accuracies():
    chance = np.random.default_rng(1)
    good = chance.random(20_000) < .75
    right, votes = [.95, .8, .7, .6], []
    for share in right:
        hit = chance.random(len(good)) < share
        cast = np.where(hit == good, quality.GOOD, quality.BAD)
        votes.append(np.where(chance.random(len(good)) < .3, quality.NONE, cast))
    patterns, counts = np.unique(np.array(votes).T, axis=0, return_counts=True)
    rows = [(tuple(p.tolist()), int(n)) for p, n in zip(patterns, counts)]
    labels = quality.fit_labellers(rows)
    found = np.array([labels[tuple(p)] for p in np.array(votes).T.tolist()]) > .5
    majority = np.array(votes).clip(-1).astype(float)
    majority = np.where(majority == quality.NONE, 0, np.where(majority == quality.GOOD, 1, -1)).sum(axis=0) > 0
    assert (found == good).mean() > max(.9, (majority == good).mean())
    assert quality.fit_labellers([]) == {}


def test_quality_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    scored = quality.scored(docs.select("doc_id", "text"))
    rows = scored.join(labels, "doc_id").select("quality", (F.col("quality_score") >= quality.THRESHOLD).alias("kept")).collect()
    good, bad = [[r["kept"] for r in rows if r["quality"] == q] for q in (1, 0)]
    assert sum(good) / len(good) > .995
    assert sum(bad) / len(bad) < .1


def test_quality_of_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows + prose(1, 20))
    scored = quality.scored(docs)
    assert scored.columns == [*docs.columns, "quality_score"]
    found = scored.collect()
    assert len(found) == len(rows) + 20 and all(0 <= r["quality_score"] <= 1 for r in found)
    assert len({r["quality_score"] for r in found if not r["text"]}) == 1
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(documents(spark, [])).collect() == []


def held_out(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def test_toxicity_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, plain = [[r["score"] >= .3 for r in rows if r["toxic"] == t] for t in (1, 0)]
    assert all(held_out(r["doc_id"]) for r in rows)
    # Some labels of this table contradict the texts.
    assert sum(toxic) / len(toxic) > .85 and sum(plain) / len(plain) < .03


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(n, text + (" vile" if n % 5 == 0 else "")) for n, text in prose(2, 400)]
    docs = documents(spark, rows)
    labels = [(n, int(n % 5 == 0)) for n, _ in rows]
    flipped = [(n, 1 - toxic if held_out(n) else toxic) for n, toxic in labels]
    one, other = [toxicity.scored(docs, spark.createDataFrame(some, "doc_id long, toxic int")).collect() for some in (labels, flipped)]
    assert sorted(one) == sorted(other)


def slow_terms(rows, discount):
    """The term of a word by the definition; rows are (words, toxic)."""
    before, types = [{}, {}], [{}, {}]
    for words, toxic in rows:
        for a, b in zip(["<s>", *words], words):
            before[toxic].setdefault(b, set()).add(a)
            types[toxic].setdefault(b[:4], set()).add(b)
    n, m = [[sum(len(v) for v in one.values()) for one in some] for some in (before, types)]
    off, off_stems = [[discount * len(one) / total for one, total in zip(some, sums)] for some, sums in ((before, n), (types, m))]
    classes = len(types[0]) + len(types[1])

    def backoff(c, stem):
        shared = ((stem in types[0]) + (stem in types[1])) / classes
        return off[c] * (max(len(types[c].get(stem, ())) - discount, 0) / m[c] + off_stems[c] * shared)

    def term(word):
        stem = word[:4]
        if stem not in types[0] and stem not in types[1]:
            return math.log(off[1] / off[0]) + math.log(off_stems[1] / off_stems[0])
        if word not in before[0] and word not in before[1]:
            return math.log(backoff(1, stem) / backoff(0, stem))
        of_stem = len(types[0].get(stem, set()) | types[1].get(stem, set()))
        likely = [max(len(before[c].get(word, ())) - discount, 0) / n[c] + backoff(c, stem) / of_stem for c in (0, 1)]
        return math.log(likely[1] / likely[0])

    return term


@pytest.mark.parametrize("slice_rows", [40, 4_000_000])
def test_evidence_matches_the_definition(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(toxicity, "SLICE_ROWS", slice_rows)
    rows = [(text, n % 3 % 2) for n, text in prose(3, 80, vocabulary=150, length=20)]
    model = toxicity.Model(spark.createDataFrame(rows, "text string, toxic int"))
    term = slow_terms([(text.split(), toxic) for text, toxic in rows], toxicity.DISCOUNT)
    tested = [rows[n][0] for n in range(30)] + ["new words only",  rows[4][0].split()[0][:4] + "zz", "", None, "a"] + [rows[2][0] + " New Words!"]
    got = toxicity.evidence(spark.createDataFrame([(n, t) for n, t in enumerate(tested)], "n int, text string"), model).collect()
    for row in got:
        words = (tested[row["n"]] or "").lower().replace("!", " ").split()
        known = [term(word) for word in words]
        width = min(toxicity.EXPRESSION, len(known))
        wanted = max((sum(known[n:n + width]) / width for n in range(len(known) - width + 1)), default=0) if known else 0
        assert row["evidence"] == pytest.approx(wanted, abs=1e-4)


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.scored(docs, some).collect()
        assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {.5}
    assert toxicity.scored(documents(spark, []), labels).collect() == []
