"""Repeatable stratified hold-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize

# Fixed values of the split hash: 32-bit result, cut on its upper 20 bits.
LOW_FACTOR, HIGH_FACTOR, SEED_FACTOR, MIX_FACTOR = 2654435761, 69069, 2654435769, 1274126177
WORD = 4294967296
HALF_WORD = 2147483648


def split_hash(key: Column, seed: int) -> Column:
    """A 32-bit number from a whole-number key, spread evenly and equal on every engine."""
    low = F.pmod(key.cast("bigint"), F.lit(HALF_WORD))
    high = F.pmod(F.floor(key.cast("bigint") / F.lit(HALF_WORD)), F.lit(HALF_WORD))
    start = F.pmod(low * F.lit(LOW_FACTOR) + F.pmod(high * F.lit(HIGH_FACTOR), F.lit(WORD))
                   + F.lit(seed * SEED_FACTOR % WORD), F.lit(WORD))
    mixed = F.pmod(start.bitwiseXOR(F.shiftright(start, 15)) * F.lit(MIX_FACTOR), F.lit(WORD))
    return mixed.bitwiseXOR(F.shiftright(mixed, 13))


def class_test_rows(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """Rows of each class that go to the test side: one row per class.

    The test side has ceil(fraction * n) rows. The training rows are shared out in
    proportion: rounded down, then one more for the largest remainders.
    """
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    everyone = Window.partitionBy(F.lit(0))  # one row per class
    n = F.sum("_rows").over(everyone)
    sized = per_class.withColumn("_train", n - F.ceil(n * F.lit(fraction))).withColumn(
        "_exact", F.col("_rows") * F.col("_train") / n)
    sized = sized.withColumn("_floor", F.floor("_exact")).withColumn(
        "_left", F.col("_train") - F.sum("_floor").over(everyone))
    place = F.row_number().over(everyone.orderBy(F.desc(F.col("_exact") - F.col("_floor")), label))
    train = F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)
    return sized.select(label, (F.col("_rows") - train).alias("_test_rows"))


def mark_split(df: DataFrame, label: str, key: str, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Append `is_test`. Within a class, the rows with the smallest (hash, key) form the test side.

    Rows are not ranked per class: a class may be most of the table. Counting rows per hash
    bucket tells in which bucket the cut falls; only that bucket (about a millionth of the
    class) is ordered, which gives the last (hash, key) on the test side. One row per class
    is then broadcast, and marking is a filter.
    """
    rows = df.select(F.col(label).alias("_label"), F.col(key).alias("_key")).where("_label is not null")
    hashed = rows.withColumn("_hash", split_hash(F.col("_key"), seed)).withColumn(
        "_bucket", F.shiftright("_hash", 12))
    buckets = hashed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = F.broadcast(class_test_rows(rows, "_label", fraction))
    cut = (
        buckets.withColumn("_upto", F.sum("_rows").over(upto)).join(sizes, "_label")
        .where("_upto >= _test_rows and _upto - _rows < _test_rows")
        .select("_label", "_bucket", (F.col("_test_rows") - F.col("_upto") + F.col("_rows")).alias("_take"))
    )
    position = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", "_key"))
    last = (
        hashed.join(F.broadcast(cut), ["_label", "_bucket"]).withColumn("_position", position)
        .where("_position = _take")
        .select("_label", F.col("_hash").alias("_last_hash"), F.col("_key").alias("_last_key"))
    )
    own = split_hash(F.col(key), seed)
    before = (own < F.col("_last_hash")) | ((own == F.col("_last_hash")) & (F.col(key) <= F.col("_last_key")))
    marked = df.where(F.col(label).isNotNull()).join(
        F.broadcast(last), F.col(label) == F.col("_label"), "left")
    return marked.select(*df.columns, F.coalesce(before, F.lit(False)).alias("is_test"))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.25,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. The marked rows are written once, as both sides are read repeatedly."""
    marked = materialize(mark_split(df, label, key, fraction, seed), "split")
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")
