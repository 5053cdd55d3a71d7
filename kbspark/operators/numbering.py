"""Ids without gaps for the rows of a batch, without sorting the batch as a whole."""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Hex digits of the hash that name a bucket: 4,096 buckets, which hold a small share of any batch each.
BUCKET_DIGITS = 3


def numbered(rows: DataFrame, key: str, blocks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rows`` with the first id of a block of ids for each entry of ``blocks``: name to (ids needed, first free id).

    Blocks follow each other without gaps in the order of the MD5 of ``key``, which is unique and not null. So ids do
    not depend on how rows are spread, and a repeated job gives the same ones. Rows are shuffled once, to buckets by
    the start of the hash; only the sums of the buckets are put in order in one place. ``rows`` are read twice.
    """
    digest = F.md5(F.col(key).cast("string"))
    placed = rows.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, BUCKET_DIGITS),
                               **{f"_n_{name}": need.cast("long") for name, (need, _) in blocks.items()}})
    sums = placed.groupBy("_bucket").agg(*[F.sum(f"_n_{name}").alias(f"_sum_{name}") for name in blocks])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_start_{name}")
                                      for name in blocks])
    inside = Window.partitionBy("_bucket").orderBy("_digest", key).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per bucket is broadcast.
    return (placed.join(F.broadcast(starts), "_bucket")
            .withColumns({name: first + F.col(f"_start_{name}") + F.coalesce(F.sum(f"_n_{name}").over(inside), F.lit(0))
                          for name, (_, first) in blocks.items()})
            .select(*rows.columns, *blocks))
