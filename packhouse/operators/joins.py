"""Lookups of a large table in smaller ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize

# Most bytes that a narrow lookup table may take in each executor, by its counted rows.
NARROW_BYTES = 256_000_000


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate after pruning, or None where the session does not expose it."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = raw.strip().lower().rstrip("b") or "0"
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def fits_broadcast(df: DataFrame) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= broadcast_limit(df)


def narrow(table: DataFrame, row_bytes: int = 100) -> DataFrame:
    """A lookup table of a few numbers, marked for broadcasting if its counted rows are within NARROW_BYTES.

    `row_bytes` is what a row takes in the hash table. The count reads no column.
    """
    return F.broadcast(table) if table.count() * row_bytes <= NARROW_BYTES else table


def lookup_join(fact: DataFrame, key: str, lookups: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Join `fact` to each (table, how) on `key`; the tables usually have one row per key.

    Where every table is under the session's broadcast limit the join moves no fact row. Beyond it these are plain joins.
    Adaptive execution (the session turns it on) splits the partition of a hot key if both sides are plain shuffles, of scans
    or written tables, and nothing else needs the partitioning; so give one lookup beyond that limit, and one that is no
    aggregate: join aggregates into one table and `settled` it first.
    """
    for table, how in lookups:
        fact = fact.join(table, key, how)
    return fact


def settled(table: DataFrame, size_of: DataFrame, label: str) -> DataFrame:
    """`table` written down, unless `size_of`, which has as many rows, is small enough to be broadcast."""
    return table if fits_broadcast(size_of) else materialize(table, label)
