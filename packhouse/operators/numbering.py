"""Running numbers over a whole table in a given order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize

# monotonically_increasing_id keeps the partition above this bit and the row below it.
ROW_BITS = 33


def _placed(df: DataFrame, order_by: Sequence[Column | str], label: str) -> DataFrame:
    """Range-sort, note partition and row of every row, and write that down once.

    Written before it is counted: a range sort samples its bounds, so computing it a second
    time may place rows elsewhere.
    """
    placed = materialize(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()), label)
    return placed.withColumn("_part", F.shiftright("_at", ROW_BITS))


def _bases(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per partition, the sums over all earlier partitions: one row per sort partition."""
    per_part = placed.groupBy("_part").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in totals.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(
        per_part.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals])
    )


def number_rows(df: DataFrame, order_by: Sequence[Column | str], out: str) -> DataFrame:
    """Append 1..n in the order of `order_by`, which should end in a unique key."""
    placed = _placed(df, order_by, "numbered")
    bases = _bases(placed, {"_base": F.lit(1)})
    row = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.join(bases, "_part").withColumn(out, F.col("_base") + row + 1).drop("_part", "_at", "_base")


def running_totals(
    df: DataFrame, order_by: Sequence[Column | str], totals: dict[str, Column]
) -> DataFrame:
    """Append running sums (this row included) of integer expressions in the given order.

    The inner window runs within a sort partition; those are cut to equal sizes by the sort.
    """
    placed = _placed(df, order_by, "running")
    for name, expression in totals.items():
        placed = placed.withColumn(name, expression.cast("bigint"))
    bases = _bases(placed, {f"_{n}": F.col(n) for n in totals})
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in totals]
    return placed.join(bases, "_part").select(
        *kept, *[(F.sum(n).over(so_far) + F.col(f"_{n}")).alias(n) for n in totals]
    )
