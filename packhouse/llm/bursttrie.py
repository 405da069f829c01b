"""The trie of conversation prefixes, built from burst tries.

A conversation is the sequence of its turns' ids: 128-bit hashes of role and text. Equal conversations are one entry with a count
and the digest of their ids. A container holds the entries below one trie head (a prefix) and starts at the root. A container
with too many rows or turns bursts: the head keeps a chain node for every turn that all its entries share, and the entries move
to containers by the next turn id, each with a head of its own. What remains is small; containers are dealt to tasks, sorted, and
swept into nodes by the lengths that neighbours share. Sums over subtrees go from the swept containers up through the heads, one
aggregation per round of bursts, so no task sees all entries of a frequent prefix.

What a task holds is bounded by a container's limits and by the longest conversation (20 bytes for each of its turns; texts
never travel). Entries of one container are distinct, so every burst parts them.

Rows are taken in the order of `turn` (nulls first); rows of one turn in the order of their hashes; repeated rows are kept. A null
role or text is empty. Rows without conv_id belong to no conversation and are left out. Other columns are not read, whatever their
names. Without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize

#: A container with more entries, or with more turns in several entries, bursts.
MAX_ENTRIES = 500
MAX_TURNS = 200_000
#: Conversation ids whose decimal text one row holds while members are hashed.
ID_BLOCK = 1 << 16
ENTRY = ["conv_id", "n", "ids", "chars", "ends_sha256"]
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, up_1 long, up_2 long")


def sequences(turns: DataFrame) -> DataFrame:
    """Per conversation its turns in order: conv_id, `ids` (two numbers a turn), `chars` (code points of each text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"),
                    F.char_length(text).alias("chars"))
    ordered = turns.filter("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select(F.col("conv_id").cast("long"), F.flatten(F.transform("t", lambda t: F.array(t.a, t.b))).alias("ids"),
                          F.transform("t", lambda t: t.chars).alias("chars"))


def _key(ids: Column) -> list[Column]:
    return [F.xxhash64(ids).alias("key_1"), F.xxhash64(F.lit("second"), ids).alias("key_2")]


def _entries(convs: DataFrame) -> DataFrame:
    """Distinct sequences: the smallest id, the number and the digest of the ids of the conversations that are one.

    Ids are put in order and written out in blocks of at most ID_BLOCK before they meet, so that of a sequence that a third of
    all conversations have, few rows meet; its digest then runs over these rows, one at a time.
    """
    blocks = convs.select("conv_id", *_key(F.col("ids"))).groupBy(
        "key_1", "key_2", F.floor(F.col("conv_id") / F.lit(ID_BLOCK)).alias("block")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("members"))
    written = blocks.select("key_1", "key_2", "block", F.col("members")[0].alias("least"),
                            F.size("members").cast("long").alias("n"),
                            F.array_join(F.col("members").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, n, digest = None, 0, 0, None

        def done(rows: list) -> pa.RecordBatch:
            kinds = (("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [name for name, _ in kinds])

        for batch in batches:
            out = []
            for a, b, _, first, count, ids in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (a, b) == key:
                    n += count
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((least, n, digest.hexdigest()))
                key, least, n, digest = (a, b), first, count, hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if key is not None:
            yield done([(least, n, digest.hexdigest())])

    met = written.repartition("key_1", "key_2").sortWithinPartitions("key_1", "key_2", "block").mapInArrow(
        run, "conv_id long, n long, ends_sha256 string")
    return met.join(convs, "conv_id").select(*ENTRY)


NOTHING = hashlib.sha256(b"").hexdigest()


class _Sweep:
    """Nodes of containers whose entries come sorted, one container after the other."""

    def __init__(self) -> None:
        self.key, self.out = None, [[] for _ in range(10)]

    def entry(self, key: tuple, depth: int, above, owner: int, n: int, ids: bytes, chars: np.ndarray, ends: str) -> None:
        """`ids` are 16 bytes a turn; the container's head is at `depth`, `above` is the id of the node over it."""
        if key != self.key:
            self.close()
            self.key, self.above, self.base = key, above, depth
            self.depth, self.parent, self.least, self.count, self.length, self.ends = [], [], [], [], [], []
            self.path, self.last = [], None
        length = len(ids) // 16
        shared = self._shared(ids) if self.last is not None else depth - 1
        del self.path[max(0, shared - depth + 1):]
        for d in range(depth + len(self.path), length + 1):
            self.parent.append(self.path[-1] if self.path else -1)
            self.path.append(len(self.depth))
            self.depth.append(d)
            self.least.append(owner)
            self.count.append(0)
            self.length.append(int(chars[d - 1]))
            self.ends.append(NOTHING)
        self.ends[self.path[-1]] = ends
        # Counts and least ids go up to the parents when the container is complete.
        self.count[self.path[-1]] += n
        self.least[self.path[-1]] = min(self.least[self.path[-1]], owner)
        self.last = ids

    def _shared(self, ids: bytes) -> int:
        """Turns that the entry shares with the one before it; all entries share `base` turns."""
        n = min(len(ids), len(self.last)) // 16
        same = np.frombuffer(ids, np.int64, 2 * n) == np.frombuffer(self.last, np.int64, 2 * n)
        differs = np.flatnonzero(~same)
        return int(differs[0]) // 2 if len(differs) else n

    def close(self) -> None:
        if self.key is None:
            return
        n = len(self.depth)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            saved[i] += (self.count[i] - 1) * self.length[i]
            leaves[i] = leaves[i] or 1
            p = self.parent[i]
            if p >= 0:
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
                self.count[p] += self.count[i]
                self.least[p] = min(self.least[p], self.least[i])
        top = [p < 0 for p in self.parent]
        columns = (self.least, self.depth, [self.above if p < 0 else self.least[p] for p in self.parent], self.count, children,
                   leaves, saved, self.ends, [self.key[0] if t else None for t in top], [self.key[1] if t else None for t in top])
        for held, more in zip(self.out, columns):
            held += more
        self.key = None

    def take(self) -> pa.RecordBatch | None:
        if not self.out[0]:
            return None
        names = [c.split()[0] for c in NODE.split(", ")]
        kinds = [pa.string() if n == "ends_sha256" else pa.int64() for n in names]
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(self.out, kinds)], names)
        self.out = [[] for _ in names]
        return batch


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of containers that do not burst; `up_1`, `up_2` of a container's head name the head above it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                plain = zip(*(part.column(c).to_pylist() for c in range(8)))
                for (up_1, up_2, a, b, depth, above, owner, n), ids, chars, ends in zip(
                        plain, part.column(8), part.column(9), part.column(10).to_pylist()):
                    sweep.entry((up_1, up_2, a, b), depth, above, owner, n, ids.values.to_numpy().tobytes(),
                                chars.values.to_numpy(), ends)
                out = sweep.take()
                if out:
                    yield out
        sweep.close()
        out = sweep.take()
        if out:
            yield out

    together = rows.select("up_1", "up_2", "key_1", "key_2", "depth", "above", "conv_id", "n", "ids", "chars", "ends_sha256")
    return together.repartition("key_1", "key_2").sortWithinPartitions("key_1", "key_2", "ids").mapInArrow(run, NODE)


def _shared_turns(low: Column, high: Column) -> Column:
    """How many turns the least and the greatest sequence, and so all between them, have in common."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.floor(F.when(at > 0, at - 1).otherwise(F.size(low)) / 2).cast("int")


def prefix_trie(convs: DataFrame, max_entries: int = MAX_ENTRIES, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences in `convs` (conv_id, ids, chars, as `sequences` gives them): its smallest
    member, depth, the smallest member of its parent, members, children, leaves and saved characters of its subtree, and the
    digest of the ids of the conversations that end there."""
    entries = materialize(_entries(convs), "entries")
    # The root always bursts: whatever the size, what follows is dealt by first turns.
    root = entries.agg(F.min("conv_id").alias("least")).first()
    if root.least is None:
        return convs.sparkSession.createDataFrame([], NODE).drop("up_1", "up_2")
    rows = entries.select(
        F.lit(0).cast("long").alias("up_1"), F.lit(0).cast("long").alias("up_2"), F.lit(0).cast("long").alias("key_1"),
        F.lit(0).cast("long").alias("key_2"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"), *ENTRY)
    heads, kept = [], []
    while True:
        left = F.size("ids") / 2 - F.col("depth")
        if heads:
            sizes = rows.groupBy("key_1", "key_2").agg(F.count(F.lit(1)).alias("rows"), F.sum(left).alias("turns"))
            big = materialize(sizes.filter((F.col("rows") > max_entries) | (F.col("rows") > 1) & (F.col("turns") > max_turns))
                              .select("key_1", "key_2"), "big")
            if big.isEmpty():
                kept.append(rows)
                break
            kept.append(rows.join(big, ["key_1", "key_2"], "left_anti"))
            rows = materialize(rows.join(big, ["key_1", "key_2"], "left_semi"), "bursting")
            shared = _shared_turns(F.min("ids"), F.max("ids"))
        else:
            shared = F.lit(0)
        # One row a head. An entry that ends at its bottom node is the least of its container.
        bottom = rows.groupBy("up_1", "up_2", "key_1", "key_2", "depth", "above").agg(
            F.min("conv_id").alias("least"), F.sum("n").alias("n"), shared.alias("bottom"),
            F.min_by(F.struct("ids", "chars", "ends_sha256"), F.size("ids")).alias("first"))
        head = materialize(bottom.select(
            "up_1", "up_2", "key_1", "key_2", "depth", "above", "least", "n", "bottom",
            F.when(F.col("bottom") >= F.col("depth"), F.slice("first.chars", F.greatest("depth", F.lit(1)),
                                                              F.col("bottom") - F.greatest("depth", F.lit(1)) + 1)).alias("chars"),
            F.when(F.size("first.ids") == 2 * F.col("bottom"), F.col("first.ends_sha256")).otherwise(NOTHING).alias("ends")),
            "heads")
        heads.append(head)
        parted = rows.join(head.select("key_1", "key_2", "least", "bottom"), ["key_1", "key_2"]).filter(
            F.size("ids") > 2 * F.col("bottom"))
        rows = parted.select(
            F.col("key_1").alias("up_1"), F.col("key_2").alias("up_2"), *_key(F.slice("ids", F.lit(1), 2 * F.col("bottom") + 2)),
            (F.col("bottom") + 1).alias("depth"), F.col("least").alias("above"), *ENTRY)
    swept = kept[0]
    for more in kept[1:]:
        swept = swept.unionByName(more)
    nodes = materialize(_swept(swept), "swept")
    found, tops = [nodes], nodes.filter("up_1 is not null")
    for head in reversed(heads):
        chain = materialize(_chain(head, tops), "chain")
        found.append(chain)
        tops = tops.unionByName(chain.filter("up_1 is not null"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("up_1", "up_2")


def _chain(head: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes that burst containers keep: from each head down to where its entries part."""
    below = tops.groupBy(F.col("up_1").alias("key_1"), F.col("up_2").alias("key_2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    joined = head.join(below, ["key_1", "key_2"], "left").fillna(0, ["children", "saved"]).fillna(1, ["leaves"])
    # A root has no text; other chains begin with the head's own.
    lengths = F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0)), "chars")).otherwise(F.col("chars"))
    steps = joined.withColumn("lengths", lengths).select("*", F.posexplode("lengths").alias("at", "length"))
    last = F.col("at") == F.size("lengths") - 1
    rest = F.aggregate(F.expr("slice(lengths, at + 1, size(lengths))"), F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.col("at") == 0
    return steps.select(
        F.col("least").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"),
        F.when(first, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
        F.when(first & (F.col("depth") > 0), F.col("up_1")).alias("up_1"),
        F.when(first & (F.col("depth") > 0), F.col("up_2")).alias("up_2"))
