import random

import pytest
from pyspark.sql import functions as F

from kbspark.functions import codes, scores, text as tx
from kbspark.operators import ingest
from tests import models

ALPHABET = list("abcABC aab  \t\n\r,;:/\\()[]{}<>._-，。：（）éÜ漢？?") + ["\r\n", "Service", "　", "\x01"]


def random_text(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    made = [(random_text(rng, 25), random_text(rng, 60)) for _ in range(400)]
    edges = [
        (",;: /", "a,;: /b"), ("x" * 51, "x" * 60), ("a a b", "aaaa"), ("a_b", "A_B a_b"), ("X.y", "x.y"),
        ("/api/x", "api x"), ("Foo bar", "foo Bar"), ("OrderService", "orderservice"), ("aa", "aaaaa"), ("", "x"),
        (" \t", "x"), ("q", ""), ("q", " \n "), ("a，b（c）", "A b C")]
    return made + edges


def test_terms_and_scores(spark, pairs):
    frame = spark.createDataFrame([(n, q, c) for n, (q, c) in enumerate(pairs)], "n int, q string, c string")
    query, content = F.col("q"), F.col("c")
    terms = tx.query_terms(query)
    rows = frame.select(
        "n", terms.alias("terms"), scores.keyword_score(terms, content).alias("keyword"),
        scores.exact_term_score(terms, content).alias("exact"), scores.symbol_score(terms, content).alias("symbol"),
        tx.preview(content).alias("preview")).collect()
    for row in rows:
        q, c = pairs[row.n]
        assert row.terms == models.terms(q), (q, c)
        visible = bool(c.strip())
        assert row.keyword == pytest.approx(models.keyword_score(q, c), abs=1e-6), (q, c)
        assert row.exact == pytest.approx(models.exact_score(q, c) if visible else 0, abs=1e-6), (q, c)
        assert row.symbol == pytest.approx(models.symbol_score(q, c) if visible else 0, abs=1e-6), (q, c)
        assert row.preview == models.preview(c)


@pytest.mark.parametrize("size, overlap", [(500, 80), (10, 3), (100, 90), (120, 0), (101, -5), (300, 150)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = [None, "", " \t\n", "\r\n", "x" * 100, "x" * 500, "x" * 501, "x" * 920, "x" * 921, "x" * 1340, "x" * 1341,
             "a" * 400 + " " * 600 + "b" * 300, " " * 900 + "tail", "漢" * 777]
    texts += [random_text(rng, 1500) for _ in range(60)]
    documents = spark.createDataFrame(
        [(n, 1, text) for n, text in enumerate(texts)], "id long, space_id long, content string")
    found = {n: [] for n in range(len(texts))}
    for row in ingest.chunk_documents(documents, size, overlap).orderBy("document_id", "chunk_index").collect():
        assert row.chunk_index == len(found[row.document_id]) and row.char_count == len(row.content)
        assert row.id == row.document_id * ingest.CHUNK_ID_FACTOR + row.chunk_index
        found[row.document_id].append(row.content)
    for n, text in enumerate(texts):
        assert found[n] == models.chunks(text, size, overlap), n
    counts = {row.id: row.chunk_count for row in ingest.chunk_counts(documents, size, overlap).collect()}
    assert counts == {n: len(pieces) for n, pieces in found.items()}


def test_chunking_needs_no_shuffle(spark, tmp_path):
    spark.range(10).selectExpr("id", "1L space_id", "repeat('ab ', 400) content").write.parquet(f"{tmp_path}/d")
    plan = ingest.chunk_documents(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Exchange" not in physical and physical.count("regexp_extract_all") == 1


def test_small_texts(spark):
    row = spark.sql("select 1").select(
        tx.session_title(F.lit(None).cast("string")).alias("a"), tx.session_title(F.lit(" \t")).alias("b"),
        tx.session_title(F.lit("  " + "t" * 60)).alias("c"), tx.context_text(F.lit("y" * 2001)).alias("d"),
        tx.context_text(F.lit(None).cast("string")).alias("e"), tx.error_text(F.lit(" ")).alias("f"),
        tx.error_text(F.lit("z" * 1200)).alias("g"), tx.has_text(F.lit(" ")).alias("h"),
        tx.has_text(F.lit("　\x1f\n")).alias("i"), codes.vector_id(F.lit(1)).alias("j"),
        codes.status_text(F.lit(9)).alias("k"), codes.retrieval_mode(F.lit(" hybrid ")).alias("l"),
        codes.retrieval_mode(F.lit("HYBRID RERANK")).alias("m")).first()
    assert (row.a, row.b, row.c) == ("Untitled session", "Untitled session", "t" * 50)
    assert (row.d, row.e, row.f, len(row.g)) == ("y" * 2000 + "...", "", "Unknown error", 1000)
    assert (row.h, row.i, row.k) == (True, False, "unknown")
    assert row.j == "85a374f4-1a5e-3a0c-b0aa-57548a471319"
    assert (row.l, row.m) == ("HYBRID", "VECTOR_ONLY")
