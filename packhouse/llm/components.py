"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, both long -> every node that isn't its component's smallest, once, with that smallest one.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest (large star, small star); the
    number of rounds grows with the logarithm of the longest chain. Minima are aggregated before the shuffle, and no
    neighbour list is ever gathered. Both sides of a join are written first, so that its shuffles are plain and adaptive
    execution splits the one of a node with very many neighbours. A lost executor costs a re-read. Self-links, repeats and an empty table are allowed.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    return edges
