"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Texts are tokenised whole by both vocabularies. Where a token of each ends at the same byte, and a token of each that begins with a
space follows, the text is cut: these shared ends are anchors, verified on the bytes of all tokens. Between anchors lie short
windows, mostly words. A window's alignment depends on its ids alone, so it is worked out once per task and kept under the tuple
of its ids. Inside a window, groups end where tokens of both end, and two tokens are linked if their bytes overlap.

A null or empty text, or one whose bytes either vocabulary does not give back, has no tokens: zeros, empty groups. Other
columns and repeated rows are kept; columns with the names of results are replaced. An empty table gives an empty result. A text is
tokenised as a whole, in some 200 bytes of memory for each of its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.llm.bpe import _ranges
from packhouse.llm.folds import pack, unpack
from packhouse.llm.words import MIX_1, RangeHash, mix, slices
from packhouse.sources.shared import materialize

#: Windows whose alignment a task keeps, and pairs whose links it adds up before it passes them on.
CACHE = 100_000
HELD_PAIRS = 500_000
#: Pairs whose counts are sent to tasks at a time: at most 17 bytes each.
BLOCK_PAIRS = 4_000_000
SLICE_BYTES = 400_000
#: Fixed value: the pattern by which byte-level pre-tokenizers of the tokenizers library cut texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level vocabulary in a file of the tokenizers library. Special tokens' strings in texts are plain text.

    Its merges must make tokens in the order of their ids. Then a merge's rank is the id it makes, and tiktoken, which goes by
    ranks and is three times as fast, gives the same ids; any other file is refused.
    """

    def __init__(self, model: bytes) -> None:
        from tiktoken import Encoding

        file = json.loads(model)
        split = file["pre_tokenizer"]
        # Printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        merged = [ranks.get(bytes(byte[c] for c in "".join(m) if c != " ")) for m in (
            m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])]
        if (file["normalizer"], split["type"], split["use_regex"], split["add_prefix_space"]) != (None, "ByteLevel", True, False) or (
                None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(ranks)):
            raise ValueError("not a plain byte-level vocabulary with merges in the order of ids")
        self.own = Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks

    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with a space before it."""
        return [self.own.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """A vocabulary of the sentencepiece library that writes a space as U+2581, begins a text with one, and falls back to bytes."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=model)

    def tokens(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, self.own.id_to_piece(i)) for i in range(self.own.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.own.encode(texts, num_threads=1)]


KINDS = {"byte_level": ByteLevel, "pieces": Pieces}


class Side:
    """One vocabulary in a task: ids of texts, and lengths and first bytes of tokens."""

    def __init__(self, kind: str, model: bytes) -> None:
        self.own = KINDS[kind](model)
        self.bytes = self.own.tokens()
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in self.bytes])

        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # The decimal ids, each with what may follow it.
        marked = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(len(self.bytes))]
        self.mark_lengths = np.array([len(m) for m in marked], np.int64)
        self.mark_starts = np.cumsum(self.mark_lengths) - self.mark_lengths
        self.marks = np.frombuffer(b"".join(marked), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.own.encode(texts)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.flat[_ranges(self.starts[ids], self.lengths[ids])].tobytes()


class Windows:
    """Alignments of windows by their ids, each worked out once."""

    def __init__(self, first: Side, second: Side) -> None:
        self.first, self.second = first, second
        self.marks = np.concatenate([first.marks, second.marks])
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[tuple[bytes, bytes], int] = {}
        self.text: list[str] = []
        self.groups, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def places(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """For each window a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]], its place among the known ones."""
        if len(self.seen) > CACHE:
            self._clear()
        names = mix(RangeHash(mix(a.astype(np.uint64) + MIX_1))(a_at[:-1], a_at[1:])) + RangeHash(
            mix(b.astype(np.uint64) + MIX_1))(b_at[:-1], b_at[1:])
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        if not (self._same(a, a_at, one[which]) and self._same(b, b_at, one[which])):
            one = which = np.arange(len(names))
        a_raw, b_raw = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        keys = [(a_raw[s:e], b_raw[t:f]) for s, e, t, f in zip(
            (4 * a_at[one]).tolist(), (4 * a_at[one + 1]).tolist(), (4 * b_at[one]).tolist(), (4 * b_at[one + 1]).tolist())]
        # Equal ids may stand under two places of `one` only if hashes were not trusted.
        new = list(dict.fromkeys(k for k in keys if k not in self.seen))
        if new:
            self._align(new)
        return np.fromiter(map(self.seen.__getitem__, keys), np.int64, len(keys))[which]

    @staticmethod
    def _same(ids: np.ndarray, at: np.ndarray, other: np.ndarray) -> bool:
        """Whether each window has the ids of the window `other` names."""
        sizes = np.diff(at)
        return bool((sizes == sizes[other]).all()) and np.array_equal(ids, ids[_ranges(at[:-1][other], sizes)])

    def _align(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Work out new windows, all in one go."""
        a = np.frombuffer(b"".join(k[0] for k in keys), np.int32)
        b = np.frombuffer(b"".join(k[1] for k in keys), np.int32)
        a_ends, b_ends = np.cumsum(self.first.lengths[a]), np.cumsum(self.second.lengths[b])
        # Between neighbouring ends of either side lies the overlap of one token of each: a link.
        ends = np.union1d(a_ends, b_ends)
        pairs = pair_code(a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)], len(self.second.bytes))
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        stops = a_ends[np.cumsum([len(k[0]) // 4 for k in keys]) - 1]
        self.seen.update(zip(keys, range(len(self.text), len(self.text) + len(keys))))
        groups = np.diff(np.searchsorted(shared, stops, side="right"), prepend=0)
        self.text += self._written(a, b, np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends), groups)
        self.groups = np.concatenate([self.groups, groups])
        self.links = np.concatenate([self.links, np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.starts = np.cumsum(self.links) - self.links

    def _written(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: np.ndarray) -> list[str]:
        """The groups of each window as text; `groups` counts them by window."""
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        a_at, b_at = a + a_last * len(self.first.bytes), b + 2 * b_last * len(self.second.bytes)
        base = len(self.first.marks)
        lengths = np.concatenate([self.first.mark_lengths[a_at], self.second.mark_lengths[b_at]])[order]
        starts = np.concatenate([self.first.mark_starts[a_at], base + self.second.mark_starts[b_at]])[order]
        raw = self.marks[_ranges(starts, lengths)].tobytes().decode()
        tokens = np.cumsum(np.bincount(a_group) + np.bincount(b_group))[np.cumsum(groups) - 1]
        ends = np.cumsum(lengths)[tokens - 1].tolist()
        return [raw[s:e - 1] for s, e in zip([0, *ends], ends)]


def vocabulary_size(side: tuple[str, bytes]) -> int:
    return len(Side(*side).bytes)


def pair_code(a: np.ndarray, b: np.ndarray, n_b: int) -> np.ndarray:
    return a.astype(np.int64) * n_b + b


RESULTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
           "pairs": "array<long>", "pair_links": "array<int>"}


class _Aligner:
    def __init__(self, first: Side, second: Side) -> None:
        self.first, self.second, self.windows = first, second, Windows(first, second)

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        n = len(texts)
        full = [i for i, t in enumerate(texts) if t]
        kept, a, b = [], [], []
        some = [texts[i] for i in full]
        for i, t, x, y in zip(full, some, self.first.encode(some) if some else [], self.second.encode(some) if some else []):
            raw = b" " + t.encode()
            if self.first.joined(x) == raw and self.second.joined(y) == raw:
                kept.append(i)
                a.append(x)
                b.append(y)
        n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
        groups, distinct = [""] * n, np.zeros(n, np.int64)
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if kept:
            n_a[kept], n_b[kept] = [len(x) for x in a], [len(y) for y in b]
            # The texts' bytes stand one after the other; each begins with a space, and so with an anchor.
            flat_a, flat_b = np.concatenate(a), np.concatenate(b)
            a_starts, b_starts = (np.cumsum(s.lengths[f]) - s.lengths[f] for s, f in (
                (self.first, flat_a), (self.second, flat_b)))
            anchors = np.intersect1d(
                a_starts[self.first.spaced[flat_a]], b_starts[self.second.spaced[flat_b]], assume_unique=True)
            a_at = np.append(np.searchsorted(a_starts, anchors), len(flat_a))
            b_at = np.append(np.searchsorted(b_starts, anchors), len(flat_b))
            places = self.windows.places(flat_a, flat_b, a_at, b_at)
            first = np.searchsorted(a_at[:-1], np.concatenate([[0], np.cumsum(n_a[kept])]))
            owner = np.repeat(np.arange(len(kept)), np.diff(first))
            n_groups[kept] = np.bincount(owner, self.windows.groups[places], len(kept)).astype(np.int64)
            links = self.windows.links[places]
            n_links[kept] = np.bincount(owner, links, len(kept)).astype(np.int64)
            known, listed = self.windows.text, places.tolist()
            for i, s, e in zip(kept, first.tolist(), first[1:].tolist()):
                groups[i] = ";".join(known[p] for p in listed[s:e])
            span = len(self.first.bytes) * len(self.second.bytes)
            every = self.windows.pairs[_ranges(self.windows.starts[places], links)]
            every = np.sort(np.repeat(owner, links) * span + every)
            new = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            owners, pairs = np.divmod(every[new], span)
            times = np.diff(np.append(new, len(every))).astype(np.int32)
            distinct[kept] = np.bincount(owners, minlength=len(kept))
        offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]).astype(np.int32))
        return [*map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]


def align(docs: DataFrame, first: tuple[str, bytes], second: tuple[str, bytes]) -> DataFrame:
    """`docs` with the alignment of `text` by two vocabularies, each a kind of `KINDS` and the bytes of its file.

    n_a, n_b, n_groups and n_links count tokens, groups and links; `groups` lists the groups as `a1,a2|b1;a3|b2,b3` in decimal
    ids; `pairs` has each linked pair once, as (id of the first) * (size of the second vocabulary) + (id of the second), and
    `pair_links` how many links hold it.
    """
    docs = docs.drop(*RESULTS)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(Side(*first), Side(*second))
        for part in slices(batches, text, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *aligner(part.column(text).to_pylist())], [*part.schema.names, *RESULTS])

    schema = docs
    for name, kind in RESULTS.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    return docs.mapInArrow(run, schema.schema)


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """Over all rows of an aligned table, per pair: `pair`, `b` (id in the second vocabulary), `count` (links), and `best`, whether
    no other pair of that id has more. Tasks add up what they can hold first; a vocabulary bounds the pairs of one id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pairs, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held)], ["pair", "count"])

        for batch in batches:
            pairs = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            times = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            held_pairs, place = np.unique(np.concatenate([held_pairs, pairs]), return_inverse=True)
            held = np.bincount(place, np.concatenate([held, times]), len(held_pairs)).astype(np.int64)
            if len(held_pairs) > HELD_PAIRS:
                yield sums()
                held_pairs, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held_pairs):
            yield sums()

    counts = aligned.select("pairs", "pair_links").mapInArrow(run, "pair long, count long").groupBy("pair").agg(
        F.sum("count").alias("count")).withColumn("b", F.col("pair") % n_b)
    counts = materialize(counts, "links")
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(most, "b").select("pair", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """`aligned` with `n_best`, links whose pair is a best one of its second id, and `count_sum`, the sum of the counts over all
    links.

    Counts go to the tasks as sorted arrays, in as many blocks of about `block_pairs` pairs as there are, one pass over
    the pairs each; pairs belong to blocks by a hash. So no task holds more than one block, however many pairs there are.
    """
    spark = aligned.sparkSession
    counts = materialize(counts, "counts")
    blocks = max(1, -(-counts.count() // block_pairs))
    out = aligned.drop("n_best", "count_sum").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for block in range(blocks):
        found = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).select("pair", "count", "best").toArrow()
        order = np.argsort(found["pair"].to_numpy())
        sent = spark.sparkContext.broadcast(pack({c: found[c].to_numpy()[order] for c in found.column_names}))
        out = out.mapInArrow(_adder(sent, out.columns), out.schema)
        if block < blocks - 1:
            out = materialize(out, "counted")
    return out


def _adder(sent, columns: list[str]):
    at = [columns.index(c) for c in ("pairs", "pair_links", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpack(sent.value)
        known, counts, best = table["pair"], table["count"], table["best"]
        for batch in batches:
            lists = batch.column(at[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            pairs = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(at[1]).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            owner, times, place = owner[hit], times[hit], place[hit]
            sums = {2: np.zeros(batch.num_rows, np.int64), 3: np.zeros(batch.num_rows, np.int64)}
            np.add.at(sums[2], owner, times * best[place])
            np.add.at(sums[3], owner, times * counts[place])
            done = list(batch.columns)
            for i, more in sums.items():
                done[at[i]] = pa.array(batch.column(at[i]).to_numpy() + more)
            yield pa.RecordBatch.from_arrays(done, batch.schema.names)

    return run
