"""Reading and writing the knowledge-base tables as Parquet with declared schemas."""

from pyspark.sql import DataFrame, SparkSession

from kbspark.schemas import SORT_KEYS, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by name. Filters on ``space_id`` prune directories, all others reach the Parquet scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Write a table in its declared schema, missing columns as null.

    Tables with a space are partitioned by it. ``rebalance`` evens out the tasks at run time: rows of a space go
    together, small spaces share a task and a large one is split over many, so neither tiny files nor one huge
    task result. A table must not be overwritten while it is read: write to a new root instead.
    """
    declared = TABLES[name]
    columns = [df[field.name].cast(field.dataType) if field.name in df.columns
               else _null(field) for field in declared]
    typed = df.select(*[column.alias(field.name) for column, field in zip(columns, declared)])
    by_space = "space_id" in declared.names and name != "eval_dataset"
    if by_space:
        typed = typed.hint("rebalance", "space_id")
    order = (["space_id"] if by_space else []) + SORT_KEYS.get(name, ["id"])
    writer = typed.sortWithinPartitions(*order).write.mode(mode)
    if by_space:
        writer = writer.partitionBy("space_id")
    writer.parquet(f"{root}/{name}")


def _null(field):
    from pyspark.sql import functions as F

    return F.lit(None).cast(field.dataType)
