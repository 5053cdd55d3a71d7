"""Helpers shared by the operators of this package."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark.operators.limits import broadcast_if
from kbspark.sources.folders import shared_folder
from kbspark.sources.shipping import ship

# Texts are cut into words block by block, so that a very long text never becomes one list of words.
BLOCK_BYTES = 1 << 20

# Rows of an Arrow batch whose texts are Python objects at a time.
_ROWS_AT_A_TIME = 128


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written to the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    ship(rows.sparkSession)
    folder = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table with a broadcast hint when its counted rows fit the bound, else for a shuffle join."""
    return broadcast_if(rows, rows.count(), row_bytes)


def free_name(rows: DataFrame, base: str) -> str:
    """A column name that ``rows`` does not have yet, in any case of letters."""
    taken, name = {column.lower() for column in rows.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def blocks(text: bytes, gap: re.Pattern) -> Iterator[bytes]:
    """Pieces of about ``BLOCK_BYTES`` that end before a match of ``gap``; together the whole text."""
    start = 0
    while len(text) - start > BLOCK_BYTES and (found := gap.search(text, start + BLOCK_BYTES)):
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def binary_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, a few rows at a time; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for start in range(0, len(column), _ROWS_AT_A_TIME):
        yield from (value or b"" for value in column.slice(start, _ROWS_AT_A_TIME).cast(kind).to_pylist())


def unsigned(column: Column) -> Column:
    """A key under which longs sort as unsigned numbers."""
    return column.bitwiseXOR(F.lit(-(1 << 63)))
