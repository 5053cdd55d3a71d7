"""The named queries: against their SQL, or against the given tables; and the pipeline against its stages' rules."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kbspark.llm import decontaminate, queries, simhash
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_are_registered():
    names = {name.split("_")[0] for name in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    error, rows = compare(spark, duck, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert error is None
    assert rows > 0


@pytest.mark.parametrize("name", ["op5_quality", "op8_sharding", "op9_simhash", "op10_toxicity"])
def test_query_has_every_document_once(spark, name):
    ids = [row["doc_id"] for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(row["doc_id"] for row in queries.QUERIES[name](spark, SF).collect()) == sorted(ids)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        assert after.columns == (columns if name != "sharding" else [*columns, "shard"])
        kept[name] = {row["doc_id"] for row in after.select("doc_id").collect()}
        assert kept[name] <= {row["doc_id"] for row in before.select("doc_id").collect()}
        if name == "near_duplicates":
            marks = simhash.near_duplicates(before).filter("doc_id = component_id")
            assert kept[name] == {row["doc_id"] for row in marks.collect()}
        if name == "decontamination":
            hits = decontaminate.with_hits(before, spark.read.parquet(f"{SF}/benchmark.parquet"), "hits")
            assert kept[name] == {row["doc_id"] for row in hits.filter(~decontaminate.contaminated(F.col("hits"))).collect()}
        before = after.cache()
    assert kept["sharding"] == kept["mixture"]
    assert {row["doc_id"] for row in corpus_pipeline.run(spark, SF).collect()} == kept["mixture"]
