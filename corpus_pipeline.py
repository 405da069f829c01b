"""From raw documents to token ids: toxic documents go, then near copies, repeated passages and benchmark passages.

Every stage takes the rows its predecessor kept, as (spark, docs, sf_dir), and is written as Parquet and read again before the
next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.llm import bpe, decontaminate, simhash, substrings, toxicity
from packhouse.llm.queries import public_vocabulary, table
from packhouse.llm.ship import shipped
from packhouse.sources.shared import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints at most 2 bits apart."""
    return simhash.one_per_group(docs, shingle=3, distance=2)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that an earlier document, or place, has; emptied documents go."""
    return substrings.cut_repeats(docs)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids, their number, and the text decoded from them (null stays null). Columns ids and n_tokens are
    replaced."""
    ranks, pattern = public_vocabulary()
    out = "decoded"
    while out in {c.lower() for c in docs.columns}:
        out = f"_{out}"
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, out=out)
    text = F.when(F.col("text").isNotNull(), F.col(out).cast("string")).alias("text")
    return coded.select(*[text if c == "text" else F.col(c) for c in docs.columns if c not in ("ids", "n_tokens")],
                        "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", shipped(without_toxic)),
    ("simhash_near_dedup", shipped(without_near_copies)),
    ("substring_dedup", shipped(without_repeated_passages)),
    ("benchmark_decontamination", shipped(without_benchmark_passages)),
    ("byte_level_bpe", shipped(encoded)),
]

#: Recompression, trained scores and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
