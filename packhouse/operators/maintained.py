"""Aggregates kept up to date from signed changes instead of being computed anew.

A change is a row with `sign` 1 (inserted) or -1 (deleted, with the values it had); a revised row is one of each. Sums
and counts add up. A maximum does not: it is looked up in the current rows, but only for the groups that may have lost theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize
from packhouse.sources.store import VersionedStore

SIGN = "sign"
#: Money in sums: exact, so that a row's deletion takes away just what its insertion added.
EXACT = "decimal(38,9)"


@dataclass(frozen=True)
class Rollup:
    """One row per value of `key`: sums of `sums`, the number of rows as `rows`, and the largest of `latest`.

    Doubles are summed as decimals. `<name>_seen` counts the values of a sum that are not null and `<name>_odd` those that no
    decimal can hold (NaN, infinities, beyond 10^29). A null key is a group like any other.
    """

    store: VersionedStore
    key: str
    rows: str
    sums: Sequence[str] = ()
    latest: Sequence[str] = ()

    def _summands(self, changes: DataFrame) -> list[Column]:
        sign = F.col(SIGN).cast("long")
        out = [F.col(self.key), sign.alias(self.rows)]
        for c in self.sums:
            value = F.col(c).try_cast(EXACT)
            seen, odd = F.col(c).isNotNull(), F.col(c).isNotNull() & value.isNull()
            known = F.coalesce(value, F.lit(0).cast(EXACT))
            out += [F.when(sign < 0, -known).otherwise(known).alias(c),
                    F.when(seen, sign).otherwise(0).alias(f"{c}_seen"), F.when(odd, sign).otherwise(0).alias(f"{c}_odd")]
        for c in self.latest:
            out += [F.when(sign > 0, F.col(c)).alias(c), F.when(sign < 0, F.col(c)).alias(f"{c}_gone")]
        return out

    def _additive(self) -> list[str]:
        return [self.rows, *[f"{c}{end}" for c in self.sums for end in ("", "_seen", "_odd")]]

    def _columns(self) -> list[str]:
        return [self.key, *self._additive(), *self.latest]

    def _summed(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """Old groups and changes added up in one shuffle, reduced in each task before it."""
        both = old.unionByName(changes, allowMissingColumns=True)
        gone = [F.max(f"{c}_gone").alias(f"{c}_gone") for c in self.latest]
        sums = [F.sum(c).cast(both.schema[c].dataType).alias(c) for c in self._additive()]
        summed = both.groupBy(self.key).agg(*sums, *[F.max(c).alias(c) for c in self.latest], *gone)
        message = F.concat(F.lit(f"more rows deleted than inserted for {self.key} "), F.coalesce(F.col(self.key).cast("string"), F.lit("null")))
        checked = F.when(F.col(self.rows) < 0, F.raise_error(message)).otherwise(F.col(self.rows))
        return summed.withColumn(self.rows, checked).where(F.col(self.rows) > 0)

    def _refreshed(self, summed: DataFrame, current: DataFrame) -> DataFrame:
        """Look up the maxima that may be lost: those not above the largest deleted value. Where a larger value was never
        deleted it stands, however many rows went."""
        lost = reduce(lambda a, b: a | b, [F.col(f"{c}_gone") >= F.coalesce(c, f"{c}_gone") for c in self.latest])
        summed = materialize(summed.withColumn("_lost", F.coalesce(lost, F.lit(False))), "summed")
        wanted = summed.where("_lost").select(F.col(self.key).alias("_wanted"))
        if wanted.isEmpty():
            return summed
        rows = current.select(self.key, *self.latest).join(wanted, F.col(self.key).eqNullSafe(F.col("_wanted")), "left_semi")
        found = rows.groupBy(F.col(self.key).alias("_key")).agg(*[F.max(c).alias(f"_{c}") for c in self.latest])
        joined = summed.join(found, F.col(self.key).eqNullSafe(F.col("_key")), "left")
        return joined.withColumns({c: F.when(F.col("_lost"), F.col(f"_{c}")).otherwise(F.col(c)) for c in self.latest})

    def apply(self, changes: DataFrame, stream: str, batch: int, current: DataFrame | None = None) -> int:
        """Add a batch of changes; returns the version that has it.

        The batches of a stream come in ascending numbers, and one that is in already changes nothing. `current` has the rows after
        the batch; it is needed for `latest`, and read only if a maximum may be lost. Only the store's parts that have
        changed groups are read and written. Deleting more than was inserted fails and leaves the store as it was.
        """
        if self.latest and current is None:
            raise ValueError("a maximum needs the current rows")
        summands = changes.select(*self._summands(changes))

        def added(old: DataFrame, batch_rows: DataFrame) -> DataFrame:
            summed = self._summed(old.select(*self._columns()), batch_rows)
            return (self._refreshed(summed, current) if self.latest else summed).select(*self._columns())

        start = summands.select(*self._columns()).limit(0)
        return self.store.merge(summands, self.key, added, start, once=(stream, batch))

    def read(self) -> DataFrame | None:
        """Key, row count, sums as doubles (null where no value was seen, NaN while an odd one is in) and maxima."""
        state = self.store.read()
        if state is None:
            return None
        sums = [F.when(F.col(f"{c}_odd") > 0, F.lit(float("nan"))).when(F.col(f"{c}_seen") > 0, F.col(c).cast("double")).alias(c)
                for c in self.sums]
        return state.select(self.key, self.rows, *sums, *self.latest)


def inserted(rows: DataFrame) -> DataFrame:
    return rows.withColumn(SIGN, F.lit(1))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.withColumn(SIGN, F.lit(-1))


def customer_rollup(store: VersionedStore) -> Rollup:
    """Orders, spend and last order of each customer."""
    return Rollup(store, "customer_id", "order_count", ["order_total"], ["order_datetime"])


def customer_order_stats(customers: DataFrame, rollup: Rollup) -> DataFrame:
    """As `orders.customer_order_stats`, from the rollup; infinite totals count as NaN, which shows as 0 in both."""
    kept = rollup.read().select(
        "customer_id", "order_count", F.col("order_total").alias("total_spend"), F.col("order_datetime").alias("last_order_datetime"))
    found = customers.select("customer_id").join(kept, "customer_id", "left")
    return found.fillna(0, ["order_count"]).fillna(0.0, ["total_spend"])


def customer_order_counts(rollup: Rollup) -> DataFrame:
    """As `orders.customer_order_counts`, from the rollup."""
    return rollup.read().select("customer_id", F.col("order_count").alias("customer_order_count"))


def line_rollup(store: VersionedStore) -> Rollup:
    """Lines of each order."""
    return Rollup(store, "order_id", "item_count")


def shipment_rollup(store: VersionedStore) -> Rollup:
    """Shipments of each order."""
    return Rollup(store, "order_id", "shipment_count")


def order_counts(orders: DataFrame, lines: Rollup, shipments: Rollup) -> DataFrame:
    """As `orders.order_counts`, from the rollups."""
    counted = orders.join(lines.read(), "order_id", "left").join(shipments.read(), "order_id", "left")
    return counted.fillna(0, ["item_count", "shipment_count"])
