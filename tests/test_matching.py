"""Both ways of the substring join, and both ways of the nearest-vector search, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark import fixed_values as fv
from kbspark.operators import best_first, contains, lookup, nearest, retrieve
from kbspark.operators.limits import broadcast_if, pin


@pytest.fixture(scope="module")
def matching():
    rng = random.Random(3)
    letters = "abc \n漢é"

    def word(most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))

    texts = [(n, rng.randint(1, 2), word(120)) for n in range(300)] + [(300, 1, None), (301, 1, "")]
    patterns = sorted({(rng.randint(1, 3), word(rng.choice([1, 2, 3, 5, 9, 20]))) for _ in range(120)})
    patterns += [(1, texts[0][2][:40]), (2, texts[1][2][:40])]
    return texts, sorted(set(patterns))


@pytest.mark.parametrize("most", [None, 1, 4])
@pytest.mark.parametrize("way", ["grams", "over the bound"])
def test_contains_join(spark, matching, way, most):
    texts, patterns = matching
    spark.conf.set("kbspark.maxBroadcastBytes", "10" if way == "over the bound" else "1000000")
    try:
        found = contains.contains_join(
            spark.createDataFrame(texts, "id long, space_id long, text string").repartition(5),
            spark.createDataFrame(patterns, "space_id long, term string"), "text", "term", "space_id", "id", most)
        rows = sorted((row.space_id, row.term, row.id) for row in found.collect())
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    wanted = []
    for space, term in patterns:
        ids = sorted(n for n, home, text in texts if home == space and text and term in text)
        wanted += [(space, term, n) for n in ids[:most]]
    assert rows == sorted(wanted)


def brute(probes, stored):
    wanted = []
    for probe, space, fetch, query in probes:
        scored = []
        for home, chunk, vector in stored:
            if home == space and vector is not None:
                a, b = np.array(query), np.array(vector)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / size), 6) + 0.0 if size else 0.0, chunk))
        wanted += [(probe, chunk, -score, rank) for rank, (score, chunk) in enumerate(sorted(scored)[:fetch], 1)]
    return sorted(wanted)


@pytest.mark.parametrize("way", ["broadcast", "slices"])
def test_nearest(spark, way):
    rng = np.random.default_rng(5)
    shared = rng.normal(size=(40, 6)).round(2)
    stored = [(int(n % 3 == 0) + 1, n, shared[n % 40].tolist()) for n in range(500)]
    stored += [(1, 900, None), (2, 901, [0.0] * 6)]
    probes = [(f"q{n}", n % 3 + 1, int(rng.integers(1, 61)), rng.normal(size=6).round(2).tolist()) for n in range(30)]
    # Six numbers of twelve bytes: slices of about seven queries.
    spark.conf.set("kbspark.maxBroadcastBytes", str(7 * 72) if way == "slices" else "1000000")
    try:
        found = nearest.nearest(
            spark.createDataFrame(probes, "probe_id string, space_id long, fetch_k int, query_vec array<float>"),
            spark.createDataFrame(stored, "space_id long, chunk_id long, embedding array<float>").repartition(7))
        rows = sorted(tuple(row) for row in found.collect())
        some = nearest.nearest(
            spark.createDataFrame(probes, "probe_id string, space_id long, fetch_k int, query_vec array<float>"),
            spark.createDataFrame(stored, "space_id long, chunk_id long, embedding array<float>"), min_score=0.5)
        assert some.count() == sum(row[2] >= 0.5 for row in rows)
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    wanted = brute(probes, stored)
    assert [(row[0], row[3]) for row in rows] == [(row[0], row[3]) for row in wanted]
    assert [row[1] for row in rows] == [row[1] for row in wanted]
    assert np.allclose([row[2] for row in rows], [row[2] for row in wanted], atol=2e-6)


def test_pin_keeps_all_rows(spark):
    rows = spark.range(100).withColumn("tags", F.array(F.col("id").cast("string")))
    pinned = pin(rows, "some")
    assert pinned.inputFiles()
    assert sorted(map(tuple, pinned.collect())) == sorted(map(tuple, rows.collect()))
    assert pinned.dtypes == rows.dtypes


def test_broadcast_only_within_the_bound(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    rows = spark.range(10)
    assert hinted(broadcast_if(rows, 10, 100)) and not hinted(broadcast_if(rows, 10_000_000, 100))


def test_kernels_in_small_steps(monkeypatch):
    """Buffers that overflow all the time give the same result as one that never does."""
    import pyarrow as pa

    from kbspark.functions import kernels

    rng = np.random.default_rng(2)
    queries = pa.table({"probe_id": [1, 2, 3], "space_id": [1, 1, 2], "fetch_k": [7, 3, 5],
                        "query_vec": rng.normal(size=(3, 4)).tolist()})
    batches = [pa.RecordBatch.from_pydict({
        "space_id": rng.integers(1, 3, 50).tolist(), "chunk_id": (np.arange(50) + 50 * n).tolist(),
        "embedding": rng.integers(-2, 3, (50, 4)).astype(float).tolist()}) for n in range(6)]

    def best():
        return sorted(repr(row) for out in kernels.QueryMatrix(queries).best(iter(batches)) for row in out.to_pylist())

    whole = best()
    for name, value in (("BLOCK_SCORES", 10), ("BLOCK_NUMBERS", 12)):
        monkeypatch.setattr(kernels, name, value)
    assert best() == whole
    assert len(whole) == 15


def test_vectors_are_not_shuffled_at_any_number_of_queries(spark, monkeypatch):
    vectors = spark.range(1000).selectExpr("1L AS space_id", "id AS chunk_id", "array(float(id), 1.0f, 2.0f) AS embedding")
    probes = spark.range(100_000).selectExpr("id AS probe_id", "1L AS space_id", "2 AS fetch_k", "array(float(id), 1.0f, 3.0f) AS query_vec")
    plans = []

    def look(parts, schema, session, name):
        plans.extend(part()._jdf.queryExecution().executedPlan().toString() for part in parts[:2])
        return session.createDataFrame([], schema)

    monkeypatch.setattr(nearest, "in_slices", look)
    spark.conf.set("kbspark.maxBroadcastBytes", "1000000")
    try:
        nearest.nearest(probes, vectors)
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    assert len(plans) == 2
    for plan in plans:
        lines = plan.splitlines()
        kernel = next(n for n, line in enumerate(lines) if "MapInArrow" in line)
        assert not any("Exchange" in line for line in lines[kernel:])


@pytest.mark.parametrize("most", [20, 10_000])
def test_lookup_in_slices(spark, most):
    rng = random.Random(9)
    wide = spark.createDataFrame([(n, f"text {n}") for n in range(200)], "id long, content string").repartition(4)
    # A third of the rows ask for one id; some ask for none, some for unknown ones.
    asked = [(n, 77 if n % 3 == 0 else rng.choice([None, *range(-5, 210)])) for n in range(300)]
    wanted = spark.createDataFrame(asked, "n int, id long")
    some = lookup.slices(wanted, "id", most)
    held = [row.n for one in some for row in one.rows(wanted, "id").collect()]
    assert sorted(held) == sorted(n for n, key in asked if key is not None)
    assert len(some) == 1 or max(one.parts for one in some) > 1
    spark.conf.set("kbspark.maxBroadcastBytes", str(most * 100))
    try:
        found = lookup.looked_up(wide, wanted, "id", 300, 100).select("n", "content").collect()
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    assert sorted(map(tuple, found)) == sorted((n, f"text {key}") for n, key in asked if key is not None and 0 <= key < 200)


def test_texts_are_not_shuffled_at_any_number_of_queries(spark, monkeypatch, tmp_path):
    spark.range(5000).selectExpr("id", "id AS document_id", "1L AS space_id", "0 AS chunk_index", "concat('text ', id) AS content"
                                 ).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    candidates = spark.range(100_000).selectExpr("id AS query_id", "id % 6000 AS chunk_id")
    plans, run = [], lookup.in_slices

    def look(parts, *rest):
        plans.extend(part()._jdf.queryExecution().executedPlan().toString() for part in parts)
        return run(parts, *rest)

    monkeypatch.setattr(lookup, "in_slices", look)
    bounds = retrieve.Bounds(100_000, 20, 100_000, 0, None)
    spark.conf.set("kbspark.maxBroadcastBytes", str(160 * 30_000))
    try:
        found = retrieve.with_chunk(candidates, chunks, bounds)
        assert found.count() == sum(n % 6000 < 5000 for n in range(100_000))
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")
    assert len(plans) == 4
    for plan in plans:
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        scan = next(line for line in plan.splitlines() if "content" in line and "Scan parquet" in line)
        assert "LessThanOrEqual(id" in scan or "GreaterThan(id" in scan


def slow_best(texts, queries):
    wanted = []
    for query, space, most, terms in queries:
        known = [term.lower() for term in terms if term.strip(" \n")]
        scored = []
        for n, home, text in texts:
            if home != space or not text or not any(term.lower() in text for term in terms):
                continue
            hits = [text.count(term) for term in known]
            share = sum(h > 0 for h in hits) / len(terms) + min(fv.HIT_BONUS_MAX, sum(hits) * fv.HIT_BONUS)
            scored.append((-round(min(1.0, share), 6) if text.strip() else 0.0, n))
        wanted += [(query, n, rank) for rank, (_, n) in enumerate(sorted(scored)[:most], 1)]
    return sorted(wanted)


@pytest.mark.parametrize("bound", ["1000000", "12000"])
def test_best_first_recall(spark, matching, bound):
    """One slice of queries and many; queries with repeated terms, without terms, and with a wide limit."""
    texts, patterns = matching
    rng = random.Random(5)
    words = [term for _, term in patterns]
    queries = [(n, rng.randint(1, 2), rng.choice([1, 3, 2000]), [rng.choice(words) for _ in range(rng.randint(1, 4))])
               for n in range(40)] + [(90, 1, 5, ["a", "a"]), (91, 1, 5, [])]
    rows = spark.createDataFrame(texts, "chunk_id long, space_id long, text string").withColumn("content", F.col("text"))
    asks = spark.createDataFrame(queries, "query_id long, space_id long, candidate_k int, terms array<string>")
    spark.conf.set("kbspark.maxBroadcastBytes", bound)
    try:
        found = best_first.best_texts(rows.repartition(5), asks.withColumn("asked", F.col("terms")))
        assert sorted(map(tuple, found.collect())) == slow_best(texts, queries)
    finally:
        spark.conf.unset("kbspark.maxBroadcastBytes")


def test_best_first_shuffles_ids_and_scores(spark, matching):
    texts, patterns = matching
    rows = spark.createDataFrame(texts, "chunk_id long, space_id long, text string").withColumn("content", F.col("text"))
    asks = spark.createDataFrame([(1, 1, 5, ["a", "bc"])], "query_id long, space_id long, candidate_k int, terms array<string>")
    plan = best_first.best_texts(rows, asks.withColumn("asked", F.col("terms")))._jdf.queryExecution().sparkPlan().toString()
    # Ranked in the tasks first; the texts meet nothing but broadcasts.
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert best_first.best_texts(rows, asks.limit(0).withColumn("asked", F.col("terms"))).collect() == []


def test_unknown_orders_are_refused(spark):
    with pytest.raises(ValueError):
        retrieve.keyword_candidates(spark.range(1), spark.range(1), None, retrieve.Options(candidate_order="best"))
    with pytest.raises(ValueError):
        retrieve.keyword_candidates(spark.range(1), spark.range(1), None,
                                    retrieve.Options(candidate_order="score", recall=lambda terms, most: terms))


def test_patterns_in_small_blocks(monkeypatch):
    """Places of any width, over the ends of texts and of blocks, against plain search."""
    import pyarrow as pa

    from kbspark.functions import substrings

    rng = random.Random(8)
    texts = ["".join(rng.choice("abé漢") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None]
    groups = [rng.choice([1, 2, None]) for _ in texts]
    patterns = sorted({(rng.choice([1, 2, 3]), text[k:k + size]) for text in texts[:60] for k, size in ((0, 1), (2, 3), (3, 7), (1, 30)) if text[k:k + size]})
    known = substrings.Patterns(pa.table([*zip(*[(*one, n) for n, one in enumerate(patterns)], strict=True)], names=["g", "p", "n"]))
    wanted = sorted((t, n) for t, (text, home) in enumerate(zip(texts, groups, strict=True)) if text and home
                    for n, (group, pattern) in enumerate(patterns) if group == home and pattern in text)
    for size in (1 << 20, 50):
        monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
        place, number = known.found(pa.array(texts, pa.string()), pa.array(groups, pa.int64()))
        assert sorted(zip(place.tolist(), number.tolist(), strict=True)) == wanted
    assert not len(substrings.Patterns(pa.table({"g": pa.array([], pa.int64()), "p": pa.array([], pa.string()), "n": pa.array([], pa.int64())}))
                   .found(pa.array(texts), pa.array(groups))[0])


def test_lowest_keys_of_patterns():
    from kbspark.functions.substrings import lowest

    keys, patterns = np.array([5, 3, 9, 3, 1, 7]), np.array([0, 0, 0, 2, 2, 0])
    assert sorted((patterns[n], keys[n]) for n in lowest(keys, patterns, 2)) == [(0, 3), (0, 5), (2, 1), (2, 3)]


@pytest.mark.parametrize("most", [None, 2])
def test_contains_join_by_bytes(spark, matching, most):
    texts, patterns = matching
    found = contains.contains_join(
        spark.createDataFrame(texts, "id long, space_id long, text string").repartition(5),
        spark.createDataFrame(patterns, "space_id long, term string"), "text", "term", "space_id", "id", most, by_bytes=True)
    wanted = [(space, term, n) for space, term in patterns
              for n in sorted(n for n, home, text in texts if home == space and text and term in text)[:most]]
    assert sorted((row.space_id, row.term, row.id) for row in found.collect()) == sorted(wanted)


def test_meetings_at_spaces_and_in_long_words(spark):
    """Patterns in several words, over spaces, in words longer than a piece, and with no gram of their own: each text once."""
    rng = random.Random(4)
    texts = [(n, "".join(rng.choice("abcd é漢" if n % 3 else "abé") for _ in range(rng.choice([0, 5, 40, 200])))) for n in range(150)]
    texts += [(200, "nothing something thing"), (201, "  thing  "), (202, "thin g"), (203, "x" * 31 + "thing" + "y" * 90 + "thing"), (204, None)]
    cut = [text[k:k + size] for _, text in texts[:60] for k, size in ((0, 4), (1, 6), (30, 5), (29, 40), (60, 80)) if text[k:k + size]]
    patterns = sorted({*cut, "thing", "g th", "g something", "g s", "a b c d", "    ", "hing", "ythin"})
    found = contains.meetings(
        spark.createDataFrame([(n, 1, text) for n, text in texts], "id long, space_id long, text string").repartition(3),
        spark.createDataFrame([(1, one) for one in patterns], "space_id long, term string"), "text", "term", "space_id", ["id"])
    wanted = [(n, 1, one) for n, text in texts for one in patterns if text and one in text]
    assert sorted((row.id, row.space_id, row.term) for row in found.collect()) == sorted(wanted)


def test_meetings_are_one_generated_stage(spark, tmp_path):
    """No step of the places of texts leaves generated code, where each place would be a row with the whole text."""
    spark.range(10).selectExpr("id", "1L AS space_id", "concat('some text ', id) AS text").write.parquet(f"{tmp_path}/texts")
    terms = spark.createDataFrame([(1, "text"), (1, "e")], "space_id long, term string")
    plan = contains.meetings(spark.read.parquet(f"{tmp_path}/texts"), terms, "text", "term", "space_id", ["id"])
    lines = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert not any("lambda" in line for line in lines)
    assert sum("Generate" in line for line in lines) == 3 and plan.count() == 20


def test_best_first_makes_texts_lower_before_they_meet_queries(spark, matching):
    """What is the same for all queries of a text, and for all texts of a term, is not made again for each pair."""
    texts, _ = matching
    rows = spark.createDataFrame(texts, "chunk_id long, space_id long, text string").withColumn("content", F.col("text"))
    asks = spark.createDataFrame([(1, 1, 5, ["a", "bc"])], "query_id long, space_id long, candidate_k int, terms array<string>")
    plan = best_first.best_texts(rows, asks.withColumn("asked", F.col("terms")))._jdf.queryExecution().sparkPlan().toString()
    scoring = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert scoring and not any("lower(" in line or "RLIKE" in line for line in scoring)


@pytest.mark.parametrize("most", [None, 3])
def test_texts_are_read_once_and_meet_patterns_by_one_number(spark, tmp_path, most):
    """Short and long patterns share a scan; the group is no second key of the join, which would not be a number then."""
    rows = [(n, n % 2 + 1, f"some Text {n} é漢") for n in range(40)] + [(90, 1, None), (91, None, "text"), (92, 2, "")]
    spark.createDataFrame(rows, "id long, space_id long, text string").write.parquet(f"{tmp_path}/texts")
    terms = [(1, "Text"), (1, "x"), (1, "é漢"), (2, "é"), (2, "漢"), (2, "e Text 1"), (2, "none"), (3, "Text"), (3, "e"), (None, "Text")]
    found = contains.contains_join(
        spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame(terms, "space_id long, term string"),
        "text", "term", "space_id", "id", most)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Scan parquet" in line and "text" in line for line in plan.splitlines()) == 1
    assert re.search(r"BroadcastHashJoin \[_code#\d+L\], \[_code#\d+L\]", plan) and "lambda" not in plan
    wanted = [(space, term, n) for space, term in terms
              for n in [n for n, home, text in rows if home == space and home and text and term in text][:most]]
    assert sorted((row.space_id, row.term, row.id) for row in found.collect()) == sorted(wanted)


def test_meetings_look_up_one_number(spark, tmp_path):
    spark.range(10).selectExpr("id", "1L AS space_id", "concat('some text ', id) AS text").write.parquet(f"{tmp_path}/texts")
    terms = spark.createDataFrame([(1, "text"), (2, "some"), (1, "e")], "space_id long, term string")
    met = contains.meetings(spark.read.parquet(f"{tmp_path}/texts"), terms, "text", "term", "space_id", ["id"])
    assert re.search(r"BroadcastHashJoin \[_code#\d+L\], \[_code#\d+L\]", met._jdf.queryExecution().executedPlan().toString())
    assert met.count() == 20
