"""Nearest stored vectors of many queries, per space."""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from kbspark import fixed_values as fv
from kbspark.functions.kernels import QueryMatrix
from kbspark.operators.limits import in_slices, max_broadcast_bytes, pin

# Bytes of a number of a query in the matrix and in its source.
_NUMBER_BYTES = 12


def nearest(probes: DataFrame, vectors: DataFrame, min_score: float | None = None) -> DataFrame:
    """Best ``fetch_k`` stored vectors per probe: ``(probe_id, chunk_id, vector_score, vector_rank)``.

    ``probes`` has one row ``(probe_id, space_id, fetch_k, query_vec)`` per query. Ranks follow the rounded cosine,
    ties by chunk id. The queries travel to the vectors, which are read where they lie and never shuffled. Beyond the
    broadcast bound the queries are cut into slices that fit, each with a scan of its own: a full slice is many
    thousand products per vector, so reading the vector again is little beside them. Only a slice's best hits are kept.
    """
    probes = probes.select("probe_id", "space_id", "fetch_k", "query_vec")
    stored = vectors.select("space_id", "chunk_id", "embedding")
    spark = probes.sparkSession
    size = probes.agg(
        F.count("*").alias("rows"), F.max(F.size("query_vec")).alias("width")).first()
    parts = max(1, math.ceil(size.rows * (size.width or 0) * _NUMBER_BYTES / max_broadcast_bytes(spark)))
    parts = min(parts, max(1, size.rows))
    if parts == 1:
        ranked = _best(probes, stored, _matrix(probes))
    else:
        probes, held = pin(probes, "probes"), []

        def one(number: int) -> DataFrame:
            while held:
                held.pop().destroy()
            some = probes.filter(F.pmod(F.xxhash64("probe_id"), F.lit(parts)) == number)
            held.append(_matrix(some))
            return _best(some, stored, held[0])

        schema = spark.createDataFrame([], f"{_schema(probes)}, vector_rank int").schema
        ranked = in_slices([lambda n=n: one(n) for n in range(parts)], schema, spark, "nearest")
        while held:
            held.pop().destroy()
    if min_score is not None:
        ranked = ranked.filter(F.col("vector_score") >= min_score)
    limits = probes.select("probe_id", "fetch_k")
    return (ranked.join(limits, "probe_id").filter(F.col("vector_rank") <= F.col("fetch_k"))
            .select("probe_id", "chunk_id", "vector_score", "vector_rank"))


def _schema(probes: DataFrame) -> str:
    return f"probe_id {probes.schema['probe_id'].dataType.simpleString()}, chunk_id long, vector_score double"


def _matrix(probes: DataFrame) -> Broadcast:
    return probes.sparkSession.sparkContext.broadcast(QueryMatrix(probes.toArrow()))


def _best(probes: DataFrame, vectors: DataFrame, matrix: Broadcast) -> DataFrame:
    """The best hits of each probe, as many as any query may ask for; every task keeps only its own best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return matrix.value.best(batches)

    order = Window.partitionBy("probe_id").orderBy(F.desc("vector_score"), "chunk_id")
    return vectors.mapInArrow(run, _schema(probes)).withColumn("vector_rank", F.row_number().over(order)).filter(
        F.col("vector_rank") <= fv.VECTOR_FETCH_CAP)
