"""Compare a Spark result with a DuckDB result, whatever their row order."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql):
    relation = con.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(relation.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    kinds = [
        (c, {type(r[i]).__name__ for r in ours} - {"NoneType"}, {type(r[i]).__name__ for r in theirs} - {"NoneType"})
        for i, c in enumerate(sorted(spark_df.columns))]
    bad = [k for k in kinds if k[1] and k[2] and k[1] != k[2]]
    if bad:
        return f"types {bad}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
