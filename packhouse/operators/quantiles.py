"""Exact quantiles of whole columns in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packhouse.functions.scalars import as_number
from packhouse.sources.shared import materialize

#: Bits of an ordered number that a pass settles; six passes settle all 64.
STEP = 12
FRACTION_BITS, LEAST_EXPONENT = 52, -1022


def with_ordered_bits(numbers: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append for each column of doubles one, named by `columns`, of whole numbers in the same order: sign, exponent and fraction
    as in memory.

    Negative numbers count down from -1. The exponent is that of a logarithm, put right where this is one off; all other
    steps are exact, as they scale by powers of two. Both zeros are 0. Infinities come beyond all finite numbers. Each step is
    a projection of its own, which computes once what the next one uses several times.
    """
    def step(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
        return rows.select("*", *[c.alias(n) for n, c in made.items()])

    def named(part: str) -> list[tuple[str, Column, str]]:
        return [(f"_{part}_{out}", F.col(x), out) for x, out in columns.items()]

    rows = step(numbers, {n: F.greatest(F.floor(F.log2(F.abs(x))), F.lit(LEAST_EXPONENT).cast("long")) for n, x, _ in named("guess")})
    # Two factors, as 2 ** -guess alone can be beyond the doubles.
    rows = step(rows, {n: F.floor(-F.col(f"_guess_{out}") / 2) for n, _, out in named("half")})
    rows = step(rows, {n: F.abs(x) * F.pow(F.lit(2.0), F.col(f"_half_{out}")) * F.pow(
        F.lit(2.0), -F.col(f"_guess_{out}") - F.col(f"_half_{out}")) for n, x, out in named("scaled")})
    over = {out: F.col(f"_scaled_{out}") >= 2 for out in columns.values()}
    under = {out: (F.col(f"_scaled_{out}") < 1) & (F.col(f"_guess_{out}") > LEAST_EXPONENT) for out in columns.values()}
    rows = step(rows, {n: F.when(over[out], F.col(f"_scaled_{out}") / 2).when(under[out], F.col(f"_scaled_{out}") * 2).otherwise(
        F.col(f"_scaled_{out}")) for n, _, out in named("fraction")} | {
        n: F.col(f"_guess_{out}") + F.when(over[out], 1).when(under[out], -1).otherwise(0) for n, _, out in named("exponent")})

    def bits(out: str) -> Column:
        # A fraction below 1 is subnormal; the exponent field is then 0.
        normal = F.when(F.col(f"_fraction_{out}") >= 1, 1).otherwise(0)
        field = F.col(f"_exponent_{out}") - F.lit(LEAST_EXPONENT) + normal
        return F.shiftleft(field.cast("long"), FRACTION_BITS) + ((F.col(f"_fraction_{out}") - normal) * 2.0**FRACTION_BITS).cast("long")

    rows = step(rows, {n: F.when(F.abs(x) == float("inf"), F.lit(2047 << FRACTION_BITS)).when(
        x == 0, F.lit(0).cast("long")).otherwise(bits(out)) for n, x, out in named("size")})
    return rows.select(*numbers.columns, *[
        F.when(F.col(x) < 0, -1 - F.col(f"_size_{out}")).otherwise(F.col(f"_size_{out}")).alias(out) for x, out in columns.items()])


@dataclass
class _Target:
    """A rank looked for among the rows of a column whose leading bits are `prefix`."""

    column: int
    rank: int
    rows: int
    prefix: int = 0
    value: float | None = None


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, nulls and NaN skipped.

    A quantile lies between two ranks. Numbers are mapped to whole ones in the same order, and each pass counts the rows by their
    next STEP bits among those that share a rank's bits so far, or by all bits left once there are at most 2 ** STEP rows, for all
    columns and ranks together; a rank is settled as soon as all rows left are equal. `df` is read once and its numbers written, with their bits; these are read at most six times,
    whatever their values, and only the columns that are still looked at. A task holds at most 2 ** STEP
    counts a rank, and one row a rank reaches the driver.
    """
    numbers = df.select(*[as_number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    numbers = materialize(with_ordered_bits(numbers, {f"x{i}": f"bits{i}" for i in range(len(columns))}), "bits")
    sizes = numbers.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    targets: dict[tuple[int, int], _Target] = {}
    for i in range(len(columns)):
        for p in probabilities if sizes[i] else ():
            position = p * (sizes[i] - 1)
            for rank in (math.floor(position), math.ceil(position)):
                targets[i, rank] = _Target(i, rank, sizes[i])
    low = 64
    while waiting := [t for t in targets.values() if t.value is None]:
        # So few rows have no more different bits than a step has.
        width = low if all(t.rows <= 1 << STEP for t in waiting) else min(STEP, low)
        low -= width
        _narrow(numbers, waiting, low, width)

    def quantile(i: int, p: float) -> float | None:
        if not sizes[i]:
            return None
        position = p * (sizes[i] - 1)
        below, above = targets[i, math.floor(position)].value, targets[i, math.ceil(position)].value
        return below if below == above else below + (position - math.floor(position)) * (above - below)

    return {c: [quantile(i, p) for p in probabilities] for i, c in enumerate(columns)}


def _narrow(numbers: DataFrame, targets: Sequence[_Target], low: int, width: int) -> None:
    """Settle the bits from `low` on, `width` of them, of each target; ranks with equal bits so far are counted once."""
    first = low + width == 64
    groups = {(t.column, t.prefix): k for k, t in enumerate(targets)}

    def member(column: int, prefix: int, k: int) -> Column:
        bits = F.col(f"bits{column}")
        here = bits.isNotNull() if first else F.shiftright(bits, low + width) == prefix
        return F.struct(F.lit(k).alias("k"), F.when(here, F.shiftright(bits, low)).alias("head"), F.col(f"x{column}").alias("x"))

    counted = numbers.select(F.inline(F.array(*[member(c, p, k) for (c, p), k in groups.items()]))).where(
        "head is not null").groupBy("k", "head").agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("least"), F.max("x").alias("most"))
    # The window runs over at most 2 ** STEP counts of each group.
    upto = F.sum("rows").over(Window.partitionBy("k").orderBy("head").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("upto", upto)
    found = counted.groupBy("k").agg(*[
        F.min(F.when((F.col("k") == groups[t.column, t.prefix]) & (F.col("upto") > t.rank),
                     F.struct("head", (F.col("upto") - F.col("rows")).alias("before"), "rows", "least", "most"))).alias(f"t{i}")
        for i, t in enumerate(targets)])
    rows = {row["k"]: row for row in found.collect()}
    for i, t in enumerate(targets):
        at = rows[groups[t.column, t.prefix]][f"t{i}"]
        t.prefix, t.rank, t.rows = at["head"], t.rank - at["before"], at["rows"]
        if at["least"] == at["most"] or low == 0:
            t.value = at["least"]
