"""Runs every named query and its SQL on one folder and compares all rows; ``python tests/check.py [sf_dir] [name …]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    cleaned = [tuple(plain(row[n]) for n in order) for row in rows]
    return sorted(columns), sorted(cleaned, key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, sf_dir, build, sql):
    """Error text, or None when both sides agree; and the row count."""
    result = build(spark, sf_dir)
    spark_side = rows_of(result.columns, [tuple(row) for row in result.collect()])
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    duck_side = rows_of(names, cursor.fetchall())
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} / {duck_side[0]}", len(spark_side[1])
    if spark_side[1] != duck_side[1]:
        only = [row for row in spark_side[1] if row not in set(duck_side[1])][:2]
        other = [row for row in duck_side[1] if row not in set(spark_side[1])][:2]
        return f"rows {len(spark_side[1])} / {len(duck_side[1])}\n  spark {only}\n  sql   {other}", len(spark_side[1])
    kinds = {field.name: field.dataType.simpleString() for field in result.schema.fields}
    sizes = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {column[0]: (kinds[column[0]], str(column[1])) for column in cursor.description
           if sizes.get(str(column[1]), str(column[1])) != kinds[column[0]]}
    return (f"types {odd}" if odd else None), len(spark_side[1])


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            error, count = compare(spark, con, sf_dir, build, oracles[name])
        except Exception as problem:  # a failing query must not stop the others
            error, count = f"{type(problem).__name__}: {str(problem)[:900]}", -1
        bad += bool(error)
        print(f"{'BAD' if error else 'ok '} {name} {count} rows {time.time() - start:.1f}s {error or ''}", flush=True)
    print("missing SQL:", sorted(set(entry.queries()) - set(oracles)), "bad:", bad)


if __name__ == "__main__":
    main()
