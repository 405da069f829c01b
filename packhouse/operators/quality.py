"""Constraint audit and data dictionary of the logical tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.schemas import TABLES, TableSpec
from packhouse.sources.tables import missing_tables


def _finding(table: str, constraint: str, kind: str, violations: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"), F.lit(constraint).alias("constraint_name"), F.lit(kind).alias("kind"),
        F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))


def _row_rules(spec: TableSpec, table: DataFrame) -> DataFrame:
    """All per-row rules of a table in one pass; a null passes a check."""
    rules = [
        _finding(spec.name, f"{c}_not_null", "not_null", F.count_if(F.col(c).isNull())) for c in spec.not_null()
    ] + [
        _finding(spec.name, name, "check", F.count_if(~F.expr(condition))) for name, condition in spec.checks
    ]
    return table.agg(F.array(*rules).alias("f")).select(F.inline("f"))


def _key_rule(spec: TableSpec, table: DataFrame) -> DataFrame:
    """Rows beyond the first of each key value."""
    key = spec.primary_key
    surplus = table.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n"))
    return surplus.agg(
        _finding(spec.name, f"{key}_unique", "primary_key", F.sum("n")).alias("f")).select("f.*")


def _reference_rule(spec: TableSpec, table: DataFrame, column: str, target: TableSpec,
                    targets: DataFrame) -> DataFrame:
    """Rows whose reference has no target. Counted per value first, so hot values cost one row each."""
    used = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = targets.select(F.col(target.primary_key).alias("k")).distinct()
    return used.join(known, "k", "left_anti").agg(
        _finding(spec.name, f"{column}_in_{target.name}", "foreign_key", F.sum("n")).alias("f")).select("f.*")


def contract_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per constraint with the number of rows that break it.

    A table that is missing has one violation of its presence rule and no other rows.
    """
    spark = next(iter(tables.values())).sparkSession
    missing = set(missing_tables(tables))
    presence = spark.createDataFrame(
        [(name, "table_present", "presence", int(name in missing)) for name in TABLES],
        "table_name string, constraint_name string, kind string, violations long")
    parts = [presence]
    for name, spec in TABLES.items():
        if name in missing:
            continue
        table = tables[name]
        parts += [_row_rules(spec, table), _key_rule(spec, table)]
        parts += [
            _reference_rule(spec, table, column, TABLES[target], tables[target])
            for column, target in spec.foreign_keys if target not in missing
        ]
    return reduce(DataFrame.unionByName, parts)


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Data dictionary of what is there, with row and null counts: one row per column, one pass per table.

    Columns and types are those of the data. Key, default and "not null" are added where the table and column are
    declared; others count as nullable unless their schema says otherwise.
    """
    def profile(name: str, table: DataFrame) -> DataFrame:
        spec = TABLES.get(name)
        declared = spec.not_null() if spec else []
        columns = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(i).alias("cid"), F.lit(field.name).alias("name"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(int(field.name in declared or not (spec or field.nullable))).alias("notnull"),
                F.lit(spec.defaults.get(field.name) if spec else None).cast("string").alias("dflt_value"),
                F.lit(int(bool(spec) and field.name == spec.primary_key)).alias("pk"),
                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"`{field.name}`").isNull()).alias("n_nulls"))
            for i, field in enumerate(table.schema)
        ]
        return table.agg(F.array(*columns).alias("p")).select(F.inline("p"))

    return reduce(DataFrame.unionByName, [profile(n, t) for n, t in tables.items() if t.columns])
