"""The corpus pipeline: quality, near duplicates, contamination, mixture and shards, in this order."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.llm import decontaminate, kd_shards, mixing, quality, simhash
from kbspark.llm.common import stored, table
from kbspark.llm.queries import SEED, mixture_domain, mixture_weights

# The mixture takes this share of the tokens that are left, in tenths.
BUDGET_TENTHS = 9
SHARDS = 8

# Benchmark passages of at least so many words are cut out of the documents that stay.
SPAN_WORDS = decontaminate.WINDOW


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier accepts."""
    return quality.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the smallest id."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than one word in twenty belongs to a benchmark passage, without the passages in them."""
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), span_words=SPAN_WORDS)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the token budget takes, once each."""
    return mixing.mixed(docs, mixture_weights(docs), mixture_domain(docs),
                        F.floor(F.col("total") * BUDGET_TENTHS / 10), seed=SEED)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard of the k-d tree."""
    return kd_shards.kd_sharded(docs, ["lang", "source", "n_chars"], leaves=SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("sharding", sharding_stage),
]

# No SQL: the classifier and the fingerprints cannot be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
