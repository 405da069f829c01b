"""Reading the logical tables from Parquet folders or from a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.schemas import FRAUD_LABEL, INT, TABLES


def load_tables(spark: SparkSession, folder: str, with_label: bool = False) -> dict[str, DataFrame]:
    """The six operational tables stored as `<folder>/<table>`; reads only what a query uses.

    `with_label` adds the training label `is_fraud`, which operational orders do not carry.
    """
    tables = {}
    for name, spec in TABLES.items():
        schema = spec.struct
        if with_label and name == "shop_orders":
            schema = schema.add(FRAUD_LABEL, INT)
        tables[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return tables


def load_available(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """As `load_tables`, without the tables that are not there."""
    found = {}
    for name, spec in TABLES.items():
        try:
            found[name] = spark.read.schema(spec.struct).parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def load_tables_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    table_names: Mapping[str, str] | None = None,
    partitions: int = 64,
) -> dict[str, DataFrame]:
    """The same tables from a database, each read in parallel ranges of its primary key.

    The key bounds come from one min/max query per table, run by the database; rows outside the
    bounds still arrive (in the first or last range). `table_names` maps logical names to
    the database's own.
    """
    tables = {}
    for name, spec in TABLES.items():
        stored = (table_names or {}).get(name, "orders" if name == "shop_orders" else name)
        reader = {"url": url, "table": stored, "properties": properties}
        key = spec.primary_key
        low, high = spark.read.jdbc(
            url, f"(select min({key}) as low, max({key}) as high from {stored}) bounds", properties=properties
        ).first()
        if low is None:
            table = spark.read.jdbc(**reader)
        else:
            table = spark.read.jdbc(
                **reader, column=key, lowerBound=low, upperBound=high + 1,
                numPartitions=partitions,
            )
        tables[name] = table.select(*[F.col(c).cast(t).alias(c) for c, t in spec.columns])
    return tables


def missing_tables(tables: Mapping[str, DataFrame]) -> list[str]:
    return [name for name in TABLES if name not in tables]
