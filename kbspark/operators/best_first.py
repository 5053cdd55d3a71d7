"""Substring recall in the order of scores: of all texts that hold any of a query's terms, the best ones.

Each text meets the terms inside it in the task that scans it, and from there the queries that ask for them. A query
that asks for several of them would be met several times; only the meeting by the first of its terms counts, so a text
and a query make one row without being gathered by key. The row is scored at once, with all terms and the whole text,
and each task keeps its best rows of a query. What is shuffled is ids and scores, ``candidate_k`` per query and task.

Terms and queries are the broadcast sides. More than fit are cut into slices of queries, one after the other, each with
a scan of its own; texts are shuffled at no number of queries.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from kbspark.functions import scores, text as tx
from kbspark.operators import contains
from kbspark.operators.limits import GROUP_LIMIT_MAX, in_slices, max_broadcast_bytes, pin

# Bytes of the broadcast rows of a query and of each of its terms beyond their text.
_ROW_BYTES = 320


def best_texts(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, keyword_rank)``: per query the ``candidate_k`` texts of the highest keyword score.

    ``texts`` has ``chunk_id, space_id, text, content``, ``queries`` has ``query_id, space_id, candidate_k, terms,
    asked``: the terms ``asked`` are sought in ``text``, the ``terms`` are scored in ``content``. Equal scores go by
    the lower chunk id. The terms of one query fit a broadcast. Spark cuts groups in the tasks only up to a number; a
    query that asks for more is ranked apart, and all its pairs of ids and scores are shuffled.
    """
    spark = queries.sparkSession
    # What does not depend on the pair of a text and a query is made once: terms as they are counted (null if never), and
    # lower-cased texts.
    counted = F.transform("terms", lambda term: F.when(tx.has_text(term), F.lower(term)))
    queries = pin(queries.select("query_id", "space_id", "candidate_k", counted.alias("counted"),
                                 F.array_distinct("asked").alias("asked")), "best-first-queries")
    texts = texts.select("chunk_id", "space_id", "text", F.lower("content").alias("lowered"),
                         tx.has_text(F.col("content")).alias("visible"))
    letters = F.aggregate("asked", F.lit(0).cast("long"), lambda n, term: n + 4 * F.octet_length(term) + _ROW_BYTES)
    some = queries.groupBy((F.col("candidate_k") > GROUP_LIMIT_MAX).alias("wide")).agg(
        F.sum(letters + _ROW_BYTES).alias("bytes"), F.max("candidate_k").alias("most")).collect()
    parts = []
    for row in some:
        of_width = queries.filter((F.col("candidate_k") > GROUP_LIMIT_MAX) == row["wide"])
        count = math.ceil(row["bytes"] / max_broadcast_bytes(spark))
        for part in range(count):
            of_part = F.pmod(F.xxhash64("query_id"), F.lit(count)) == part
            parts.append(lambda rows=of_width.filter(of_part), most=row["most"]: _best(texts, rows, most))
    if len(parts) == 1:
        return parts[0]()
    return in_slices(parts, _best(texts, queries.limit(0), 1).schema, spark, "best-texts")


def _best(texts: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    words = queries.select("query_id", "space_id", F.posexplode("asked").alias("place", "term"))
    met = contains.meetings(texts, words.select("space_id", "term").filter("term <> ''").distinct(), "text", "term",
                            "space_id", ["chunk_id", "text", "lowered", "visible"])
    pairs = (met.join(F.broadcast(words), ["space_id", "term"])
             .join(F.broadcast(queries.select("query_id", "candidate_k", "counted", "asked")), "query_id"))
    earlier = F.exists(F.slice("asked", F.lit(1), F.col("place")), lambda term: F.contains("text", term))
    # Counted in bytes, which a text knows of itself. Spark keeps this step apart: the hits are made once and read twice.
    hits = F.transform("counted", lambda term: F.coalesce(
        ((F.octet_length("lowered") - F.octet_length(F.replace("lowered", term, F.lit("")))) / F.octet_length(term)).cast("int"),
        F.lit(0)))
    scored = pairs.filter(~earlier).select("query_id", "chunk_id", "candidate_k", "visible", hits.alias("hits")).select(
        "query_id", "chunk_id", "candidate_k", scores.score_of_hits(F.col("hits"), F.col("visible")).alias("keyword_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "chunk_id")
    ranked = scored.withColumn("keyword_rank", F.row_number().over(order)).filter(F.col("keyword_rank") <= most)
    return ranked.filter(F.col("keyword_rank") <= F.col("candidate_k")).select("query_id", "chunk_id", "keyword_rank")
