"""Token totals by source, language and tokenizer version, kept by signed changes.

A batch of inserted, deleted or re-counted documents is reduced to signed sums per key before it is written, so what a batch
adds is one row per key. A batch becomes part of the totals when its marker appears, in one step and under its id: a batch that
is applied again, after a crash or by a second writer, finds the marker and changes nothing. Totals are the sums of all
committed changes; no document is ever counted again.

`compact` replaces the changes committed so far by one snapshot, which appears in one step and holds their sums and the ids of
their batches, so that totals read it and the few changes since, and an old batch is still known.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.sources.store import children, delete, publish, read_text

KEYS = ["source", "lang", "tokenizer"]
COMMIT = "batch string, path string"
#: Batch ids in a file of a snapshot; they are sorted, so that a look-up reads few row groups.
FILE_BATCHES = 4_000_000
SIGNED = "source string, lang string, tokenizer string, docs long, tokens long"

#: Tokenizer versions that are patterns: a token is a match.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+",
}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a version of PATTERNS; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def counted(docs: DataFrame, version: str) -> DataFrame:
    """source, lang, tokenizer, tokens of each document (text, source, lang)."""
    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer"),
                       count_tokens(F.col("text"), version).alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes for new documents: rows of source, lang, tokenizer, tokens. Null tokens count as 0."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes for documents that go, as they were counted when they came."""
    return _signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes for documents whose key or count changes."""
    return deletes(before).unionByName(inserts(after))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"),
                         (F.coalesce(F.col("tokens"), F.lit(0)).cast("long") * sign).alias("tokens"))


def _summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> DataFrame:
        """One row per batch committed since the last cleaning: its id and the folder of its sums."""
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.root}/commits/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def _snapshot(self) -> tuple[int, str | None]:
        """Number and folder of the newest snapshot; 0 and None before the first."""
        numbers = [int(n) for n in children(self.spark, f"{self.root}/snapshots") if n.isdigit()]
        if not numbers:
            return 0, None
        found = json.loads(read_text(self.spark, f"{self.root}/snapshots/{max(numbers)}"))
        return max(numbers), found["path"]

    def _compacted(self, path: str | None) -> DataFrame:
        """Ids of the batches in a snapshot."""
        if path is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.root}/{path}/batches")

    def _since(self, path: str | None) -> list[tuple[str, str]]:
        """Batch and folder of the commits that a snapshot does not hold: as many as come between two compactions."""
        rows = self.commits().join(self._compacted(path), "batch", "left_anti").collect()
        return [(r.batch, r.path) for r in rows]

    def _sums(self, path: str | None, changes: list[str]) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in ([f"{path}/sums"] if path else []) + changes]
        return _summed(self.spark.read.schema(SIGNED).parquet(*paths) if paths else self.spark.createDataFrame([], SIGNED))

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Add the signed changes of batch `batch`; False, and nothing changes, if a batch of this id was applied before.

        A batch is known by its id alone; a second batch under an id in use is ignored whatever it holds. (Of a writer that looked
        before a compaction and commits after the cleaning, the second commit is not refused but left out of the totals.)
        """
        same = F.col("batch") == batch
        if self.commits().filter(same).first() or self._compacted(self._snapshot()[1]).filter(same).first():
            return False
        path = f"changes/{uuid.uuid4().hex}"
        _summed(signed).write.parquet(f"{self.root}/{path}")
        name = hashlib.sha256(batch.encode()).hexdigest()
        return publish(self.spark, f"{self.root}/commits/{name}", json.dumps({"batch": batch, "path": path}) + "\n")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches, without keys that came to nothing.

        Null is a key like any other. No batch, or only empty ones, gives an empty table.
        """
        _, path = self._snapshot()
        sums = self._sums(path, [p for _, p in self._since(path)])
        return sums.withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})

    def compact(self) -> bool:
        """Make a snapshot of all committed batches; False if there is nothing new, or another writer made one first.

        What a crash leaves before the snapshot appears is never read.
        """
        number, old = self._snapshot()
        since = self._since(old)
        if not since:
            return False
        path = f"compacted/{uuid.uuid4().hex}"
        self._sums(old, [p for _, p in since]).write.parquet(f"{self.root}/{path}/sums")
        ids = self._compacted(old).unionByName(self.spark.createDataFrame([(b,) for b, _ in since], "batch string"))
        ids = ids.repartitionByRange(-(-ids.count() // FILE_BATCHES), "batch").sortWithinPartitions("batch")
        ids.write.parquet(f"{self.root}/{path}/batches")
        return publish(self.spark, f"{self.root}/snapshots/{number + 1}", json.dumps({"path": path}) + "\n")

    def clean(self) -> None:
        """Delete the commits and changes that the newest snapshot holds, and older snapshots.

        Only while no one reads totals that were asked for before that snapshot.
        """
        number, path = self._snapshot()
        if path is None:
            return
        for r in self.commits().join(self._compacted(path), "batch", "left_semi").collect():
            delete(self.spark, f"{self.root}/commits/{hashlib.sha256(r.batch.encode()).hexdigest()}")
            delete(self.spark, f"{self.root}/{r.path}")
        for name in children(self.spark, f"{self.root}/snapshots"):
            if name.isdigit() and int(name) < number:
                folder = json.loads(read_text(self.spark, f"{self.root}/snapshots/{name}"))["path"]
                delete(self.spark, f"{self.root}/snapshots/{name}")
                delete(self.spark, f"{self.root}/{folder}")
