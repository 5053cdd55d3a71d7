import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import toxicity
from tests.llm.samples import prose
from tests.llm.test_quality_and_toxicity import SF, slow_terms


def test_long_ordinary_documents_do_not_score_higher(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    words = docs.select("doc_id", F.size(F.split("text", r"\s+")).alias("n"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").join(words, "doc_id").filter("held_out AND toxic = 0").collect()
    short, long = [np.mean([r["score"] for r in rows if low <= r["n"] < high]) for low, high in ((100, 300), (1000, 10**9))]
    assert long < 2 * short


def test_whole_text_is_the_mean_of_its_terms(spark):
    rows = [(text, n % 3 % 2) for n, text in prose(3, 80, vocabulary=150, length=20)]
    model = toxicity.Model(spark.createDataFrame(rows, "text string, toxic int"))
    term = slow_terms([(text.split(), toxic) for text, toxic in rows], toxicity.DISCOUNT)
    tested = [rows[n][0] for n in range(30)] + ["", None]
    for row in toxicity.evidence(spark.createDataFrame(list(enumerate(tested)), "n int, text string"), model).collect():
        words = (tested[row["n"]] or "").split()
        assert row["words"] == len(words)
        assert row["whole"] == pytest.approx(np.mean([term(word) for word in words]) if words else 0, abs=1e-4)


def slow_given(rows, discount):
    """The term of a word given the word before, less what the lower order says; rows are (words, toxic)."""
    counts = [{}, {}]
    for words, toxic in rows:
        for a, b in zip(["<s>", *words], words):
            counts[toxic].setdefault(a, []).append(b)

    def likely(c, a, b, lower):
        after = counts[c].get(a, [])
        if not after:
            return lower
        return max(after.count(b) - discount, 0) / len(after) + discount * len(set(after)) / len(after) * lower

    return likely


@pytest.mark.parametrize("slice_rows", [200, 4_000_000])
def test_pairs_are_interpolated_with_the_lower_order(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(toxicity, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 50)
    rows = [(text, n % 3 % 2) for n, text in prose(3, 80, vocabulary=150, length=20)]
    split = [(text.split(), toxic) for text, toxic in rows]
    model = toxicity.Model(spark.createDataFrame(rows, "text string, toxic int"))
    alone, lower = slow_terms(split, toxicity.DISCOUNT), slow_lower(split, toxicity.DISCOUNT)
    given = slow_given(split, toxicity.DISCOUNT)
    known = {word for words, _ in split for word in words}
    tested = [rows[n][0] for n in range(20)] + [" ".join(reversed(split[n][0])) for n in range(20)]
    got = toxicity.evidence(spark.createDataFrame(list(enumerate(tested)), "n int, text string").coalesce(1), model).collect()
    assert [row["n"] for row in got] == list(range(len(tested)))
    for row in got:
        words = tested[row["n"]].split()
        assert set(words) <= known
        terms = [np.log(given(1, a, b, lower(1, b)) / given(0, a, b, lower(0, b))) for a, b in zip(["<s>", *words], words)]
        width = min(toxicity.EXPRESSION, len(terms))
        assert row["whole_given"] == pytest.approx(np.mean(terms), abs=1e-4)
        assert row["sequence"] == pytest.approx(max(
            np.mean(terms[n:n + width]) for n in range(len(terms) - width + 1)), abs=1e-4)
        assert row["whole"] == pytest.approx(np.mean([alone(word) for word in words]), abs=1e-4)


def slow_lower(rows, discount):
    before, types = [{}, {}], [{}, {}]
    for words, toxic in rows:
        for a, b in zip(["<s>", *words], words):
            before[toxic].setdefault(b, set()).add(a)
            types[toxic].setdefault(b[:4], set()).add(b)
    classes = len(types[0]) + len(types[1])

    def likely(c, word):
        stem, n, m = word[:4], sum(map(len, before[c].values())), sum(map(len, types[c].values()))
        shared = ((stem in types[0]) + (stem in types[1])) / classes
        backoff = discount * len(before[c]) / n * (max(len(types[c].get(stem, ())) - discount, 0) / m
                                                   + discount * len(types[c]) / m * shared)
        of_stem = len(types[0].get(stem, set()) | types[1].get(stem, set()))
        return max(len(before[c].get(word, ())) - discount, 0) / n + backoff / of_stem

    return likely


def test_a_sequence_of_ordinary_words_is_toxic(spark):
    chance = np.random.default_rng(5)
    vocabulary = ["".join(chance.choice(list("bcdfgh"), 5)) for _ in range(60)]
    rows = []
    for n in range(1200):
        words, toxic = list(chance.choice(vocabulary, 40)), n % 3 == 0
        # Both classes have both words as often; the toxic one has them in this order.
        words[10:10] = ["left", "right"] if toxic else ["right", "left"]
        rows.append((n, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = toxicity.scored(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    found = scores.join(docs, "doc_id").filter("held_out").collect()
    toxic, plain = [[r["score"] >= .3 for r in found if r["toxic"] == t] for t in (1, 0)]
    assert np.mean(toxic) > .9 and np.mean(plain) < .1


def test_larger_sides_are_not_gathered_for_the_pairs(spark, monkeypatch):
    """The terms of pairs are the same whether the words meet them in a broadcast or a merge join."""
    docs = spark.createDataFrame([(text, n % 3 % 2) for n, text in prose(4, 60, vocabulary=40, length=20)], "text string, toxic int")

    def terms():
        return sorted((row["key"], round(row["term"], 5)) for row in toxicity.Model(docs).tables[3].collect())

    small = terms()
    monkeypatch.setattr(toxicity, "JOINED_BYTES", 0)
    side = toxicity._joined(spark.range(5), 8)
    assert "SortMergeJoin" in spark.range(9).join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert small and terms() == small


def test_filters_are_filled_in_small_steps(spark, monkeypatch):
    """Segments that go over many batches have all bits of their pairs; no group is gathered."""
    monkeypatch.setattr(toxicity, "SEGMENTS", 4)
    monkeypatch.setattr(toxicity, "SEGMENTS_AT_A_TIME", 3)
    rng = np.random.default_rng(4)
    rows = [(int(pair) % 2, n % 3 % 2, int(pair)) for n, pair in enumerate(rng.integers(0, 1 << 62, 400))]
    sizes = {(part, toxic): 64 * (3 + part + toxic) for part in (0, 1) for toxic in (0, 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = toxicity._filters(spark.createDataFrame(rows, "part int, toxic int, pair long"), sizes)
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
        found = {(row.part, row.toxic, row.segment): bytes(row.bits) for row in made.collect()}
        assert made.count() == len(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {}
    for part, toxic, pair in rows:
        key = (part, toxic, (pair ^ pair >> 32) & 3)
        marks = wanted.setdefault(key, np.zeros(sizes[part, toxic], dtype=bool))
        for bit in toxicity._bits_of(np.array([pair], np.uint64), len(marks)):
            marks[bit] = True
    assert found == {key: np.packbits(marks, bitorder="little").tobytes() for key, marks in wanted.items()}


@pytest.mark.parametrize("slice_rows", [200, 4_000_000])
def test_words_are_looked_up_in_small_steps(spark, monkeypatch, slice_rows):
    """A block of texts is looked up some words at a time, over the ends of texts, with the same terms."""
    monkeypatch.setattr(toxicity, "SLICE_ROWS", slice_rows)
    rows = [(text, n % 3 % 2) for n, text in prose(3, 80, vocabulary=150, length=20)]
    model = toxicity.Model(spark.createDataFrame(rows, "text string, toxic int"))
    tested = spark.createDataFrame([(n, rows[n % 30][0] if n % 7 else None) for n in range(60)], "n int, text string").coalesce(1)
    whole = toxicity.evidence(tested, model).collect()
    monkeypatch.setattr(toxicity, "STEP_WORDS", 7)
    assert toxicity.evidence(tested, model).collect() == whole and any(row["words"] for row in whole)
