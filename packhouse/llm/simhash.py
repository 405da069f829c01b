"""Near-duplicate groups by SimHash, with pigeonring filtering of the candidates.

Method. A 64-bit fingerprint is a ring of `SEGMENTS` equal segments. If two differ in at most `distance` bits, some
segment of the ring starts a chain in which the first l segments together differ in at most floor(l * distance /
SEGMENTS) bits, for every l up to the whole ring. The first segments of that chain must agree entirely, so fingerprints
meet in buckets named by (start, these segments); there the chain's other budgets are checked, then the full distance.
A bucket with more than `BUCKET` fingerprints is split by the chain's next budget (at most one bit over all segments but
the last): one sub-bucket for "no difference" and one for each bit left out. What agrees there has at most 2 * 2^8
different fingerprints, so no task ever compares an unbounded group, no row is dropped, and no pair within the distance
is lost. A bucket hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packhouse.llm.components import stars
from packhouse.llm.words import hashes, slices, texts_of
from packhouse.sources.shared import materialize

SEGMENTS, BITS = 8, 8
BUCKET = 512
# Columns that no table of documents should have.
OWN_NAME, OWN_OTHER, OWN_PLACE = "__simhash_name", "__simhash_other", "__simhash_place"
LANES = np.uint64(0x0101010101010101)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words, repeats included; a shorter text is one shingle, an empty one has none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of hashes, the bits set in over half of them. Groups are not empty.

    Eight bits at a time are added in byte lanes of one word, over at most 255 hashes, so no lane overflows.
    """
    chunks = -(-counts // 255)
    first = np.cumsum(chunks) - chunks
    within = np.arange(chunks.sum()) - np.repeat(first, chunks)
    at = np.repeat(starts, chunks) + 255 * within
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, at)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for j in range(8):
            out |= (2 * sums[:, j] > counts).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprints(size: int):
    """All columns but the text, which is the second one, and the fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [hashes(s, len(s)) for s in (shingles(t.lower().split(), size) for t in texts_of(part))]
            counts = np.array([len(x) for x in own], np.int64)
            out, some = np.zeros(len(own), np.uint64), counts > 0
            if some.any():
                out[some] = majority(np.concatenate(own), (np.cumsum(counts) - counts)[some], counts[some])
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out.view(np.int64))], [*names, "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every whole text; A-Z in lower case; null and blank texts give 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints(shingle), "doc_id long, fp long")


def _budget(length: int, distance: int) -> int:
    return length * distance // SEGMENTS


def _linked(members: np.ndarray, bucket: np.ndarray, start: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs in one bucket (rows sorted by bucket) whose chain keeps its budgets and whose distance is small."""
    left, right = [], []
    lag, alive = 1, np.arange(len(members) - 1)
    while len(alive := alive[(alive + lag < len(members))]):
        alive = alive[bucket[alive] == bucket[alive + lag]]
        differ = members[alive] ^ members[alive + lag]
        turn = start[alive].astype(np.uint64) * np.uint64(BITS)
        ring = (differ >> turn) | np.where(turn > 0, differ << ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        ok, total = np.ones(len(alive), bool), np.zeros(len(alive), np.int64)
        for length in range(1, SEGMENTS + 1):
            total += np.bitwise_count((ring >> np.uint64(BITS * (length - 1))) & np.uint64(2**BITS - 1))
            ok &= total <= _budget(length, distance)
        ok &= np.bitwise_count(differ) <= distance
        left.append(alive[ok])
        right.append(alive[ok] + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n indexes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                members = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = np.diff(lists.offsets.to_numpy())
                start = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
                left, right = _linked(members, np.repeat(np.arange(len(sizes)), sizes), start, distance)
                label = _forest(len(members), left, right)
                rest = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(members[rest].view(np.int64)), pa.array(members[label[rest]].view(np.int64))], ["a", "b"])
    return run


def _turned(fp: Column, start: int) -> Column:
    if start == 0:
        return fp
    return F.shiftrightunsigned(fp, BITS * start).bitwiseOR(F.shiftleft(fp, 64 - BITS * start))


def near_links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints `fp` -> links (a, b) that connect whatever is connected by pairs within `distance` bits.

    `distance` is 1 to 3. Up to 2, a bucket over `bucket` splits into bounded ones; at 3 the last budget allows more.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    exact = max(n for n in range(1, SEGMENTS) if _budget(n, distance) == 0)
    mask = F.lit((1 << BITS * exact) - 1).cast("long")
    # at most one difference up to here
    inner = max(n for n in range(exact, SEGMENTS) if _budget(n, distance) <= 1)
    turned = fps.select("fp", F.posexplode(F.array(*[_turned(F.col("fp"), i) for i in range(SEGMENTS)])).alias("start", "ring"))
    keyed = turned.withColumn("key", F.col("ring").bitwiseAND(mask))
    # Written first: joins of two plain shuffles are split where one key has very many rows.
    full = materialize(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1"), "full")
    keyed = keyed.join(full, ["start", "key"])
    whole = F.lit((1 << BITS * inner) - 1).cast("long")
    holes = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(BITS * exact, BITS * inner)])
    keyed = keyed.withColumn("hole", F.explode(F.when(F.col("n") > bucket, holes).otherwise(F.array(F.lit(-1).cast("long")))))
    keyed = keyed.withColumn("key", F.when(F.col("hole") < 0, F.col("key")).otherwise(
        F.col("ring").bitwiseAND(whole).bitwiseAND(F.bitwise_not("hole"))))
    groups = keyed.groupBy("start", "key", "hole").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    return groups.select("start", "members").mapInArrow(_links(distance), "a long, b long")


def _rooted(fps: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Rows of distinct fingerprints `fp`, with the smallest fingerprint of the group as `root`."""
    star = stars(near_links(fps.select("fp"), distance, bucket)).withColumnsRenamed({"a": "fp", "b": "root"})
    return fps.join(star, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over fingerprints at most `distance` bits apart, itself
    included. Null and blank texts have fingerprint zero and link like any other. A row without doc_id keeps its place in its
    group, but never names one; a group of such rows only has a null component_id. Repeated rows are all returned. Other
    columns of `docs` are ignored; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, shingle), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    rooted = materialize(_rooted(fps, distance, bucket), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _names() -> list[Column]:
    """Two 64-bit hashes of id and text together; both tell a row without id from any with one."""
    both = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return [F.xxhash64(*both).alias(OWN_NAME), F.xxhash64(F.lit(1), *both).alias(OWN_OTHER)]


def one_per_group(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group of `docs`, with all columns: the one with the smallest doc_id.

    If several texts of a group share that id, the one with the smallest fingerprint stays, then the one with the smallest hash;
    of rows with equal id and text any one. A row without doc_id stays only where no row of its group has one. The same doc_id
    in two groups stays in both.
    """
    own = [OWN_NAME, OWN_OTHER]
    marked = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_names()).mapInArrow(
        _fingerprints(shingle), f"doc_id long, {OWN_NAME} long, {OWN_OTHER} long, fp long"), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", *own))
    fps = materialize(marked.groupBy("fp").agg(least.alias("first")), "fingerprints")
    kept = _rooted(fps, distance).groupBy("root").agg(F.min("first").alias("first")).select(*[f"first.{c}" for c in own])
    # Cut to one row in each task before the shuffle, which the join uses again.
    place = F.row_number().over(Window.partitionBy(*own).orderBy(OWN_NAME))
    found = docs.select("*", *_names()).withColumn(OWN_PLACE, place).filter(F.col(OWN_PLACE) == 1)
    return found.join(kept, own, "left_semi").select(docs.columns)
