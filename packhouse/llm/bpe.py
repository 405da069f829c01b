"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary, in padded numpy matrices.

A text is split by a pattern and each match is merged by itself. A match that is a token is its id; the others start as single
bytes, are sorted into length buckets and stacked as rows of a padded matrix. In each round every row merges its
pair of minimum rank, from the left wherever it occurs without overlap; pair ranks come from an open-addressing hash table, the rows
are compacted, and rows without a mergeable pair leave. A row has as many rounds as there are ranks in it, so a match of any length
goes this way.

This equals merging one leftmost pair a round if the bytes of every token, by themselves, merge into that token. For then no
new pair has a lower rank than the pair just merged: the bytes of the token it makes would have become that token before. `together`
checks this once, on the driver; with a vocabulary where it fails, rows merge one pair a round.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.llm.words import MIX_1, slices

#: Encoded matches kept between slices of a task.
CACHE = 200_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the joined token, by hashing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[waiting[free]]
            won = self.keys[slot] == keys[waiting]
            self.values[slot[won]] = joined[waiting[won]]
            waiting, slot = waiting[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX_1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of joined tokens, NONE where there is none. Negative ids (padding) join with nothing."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        out = np.full(keys.shape, NONE)
        keys, flat = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks of a byte-level vocabulary that has all single bytes; a token's id is its rank. `together` says whether all places
    of a pair may be merged in one round."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, together: bool = False) -> None:
        self.ranks, self.pattern, self.together = ranks, regex.compile(pattern), together
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[a], ranks[b], r) for t, r in ranks.items() for i in range(1, len(t))
                 if (a := t[:i]) in ranks and (b := t[i:]) in ranks]
        self.pairs = PairTable(*np.array(found or np.zeros((0, 3)), np.int64).T.astype(np.int32))
        self.tokens = {r: t for t, r in ranks.items()}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pieces in an order of our own, the number of ids of each, and all ids in that order."""
        places, ids = [], []
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                places.append([i])
                ids.append([known])
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        sizes = [[len(x) for x in ids]]
        for members in buckets.values():
            for some, counts, flat in self._merge_bucket(pieces, members):
                places.append(some)
                sizes.append(counts)
                ids.append(flat)
        join = [np.zeros(0, np.int64)]
        return (np.concatenate(join + places).astype(np.int64), np.concatenate(join + sizes).astype(np.int64),
                np.concatenate(join + ids).astype(np.int32))

    def _merge_bucket(self, pieces: list[bytes], members: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        width = max(len(pieces[i]) for i in members)
        step = max(1, 500_000 // width)
        for at in range(0, len(members), step):
            some = members[at:at + step]
            yield some, *self._merge_rows([pieces[i] for i in some], width)

    def whole_tokens(self) -> bool:
        """Whether the bytes of every token merge into that token, one leftmost pair a round."""
        tokens = sorted(self.ranks, key=len)
        buckets: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            buckets.setdefault((len(t) - 1).bit_length(), []).append(i)
        return all((counts == 1).all() and flat.tolist() == [self.ranks[tokens[i]] for i in some]
                   for members in buckets.values() for some, counts, flat in self._merge_bucket(tokens, members))

    def _merge_rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids, row after row."""
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes[raw], np.int32(-1))
        # The rank of each id with the one after it; the last column has none.
        ranks = np.full(ids.shape, NONE)
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        done = np.full(raw.shape, np.int32(-1))
        rows = np.arange(len(pieces))
        while True:
            low = ranks.min(axis=1)
            on = low < NONE
            done[rows[~on], :ids.shape[1]] = ids[~on]
            rows, ids, ranks, low = rows[on], ids[on], ranks[on], low[on]
            if not len(rows):
                return sizes, done[done >= 0]
            merged = self._places(ranks == low[:, None])
            sizes[rows] -= merged.sum(axis=1)
            ids[merged] = np.broadcast_to(low[:, None], ids.shape)[merged]
            keep = ids >= 0
            keep[:, 1:] &= ~merged[:, :-1]
            # Compaction: what stays moves to the front of its row.
            row, old = np.nonzero(keep)
            starts = np.searchsorted(row, np.arange(len(rows)))
            column = np.arange(len(row)) - starts[row]
            shape = len(rows), int(column.max()) + 1
            packed, fresh, stale = np.full(shape, np.int32(-1)), np.full(shape, NONE), np.zeros(shape, bool)
            packed[row, column], fresh[row, column] = ids[row, old], ranks[row, old]
            stale[row, column] = merged[row, old]
            stale[:, :-1] |= stale[:, 1:]
            line, at = np.nonzero(stale)
            inside = at < shape[1] - 1
            fresh[line[~inside], at[~inside]] = NONE
            line, at = line[inside], at[inside]
            fresh[line, at] = self.pairs(packed[line, at], packed[line, at + 1])
            ids, ranks = packed, fresh

    def _places(self, hit: np.ndarray) -> np.ndarray:
        """Of the places where a row's pair of minimum rank is, those to merge: the first, or from the left all without overlap."""
        if not self.together:
            first = np.zeros(hit.shape, bool)
            first[np.arange(len(hit)), hit.argmax(axis=1)] = True
            return first
        place = np.arange(hit.shape[1])
        begins = hit.copy()
        begins[:, 1:] &= ~hit[:, :-1]
        # Neighbouring places overlap: every other one of a run is merged.
        run = np.maximum.accumulate(np.where(begins, place, 0), axis=1)
        return hit & ((place - run) % 2 == 0)


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, space, rank per line), read once on the driver; its size bounds what tasks receive."""
    with open(path, "rb") as file:
        return file.read()


def parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


def vocabulary(ranks: bytes, pattern: str, together: bool = False) -> Vocabulary:
    """Built anew by each task, in about half a second: idle Python workers should hold no tables."""
    return Vocabulary(parsed(ranks), pattern, together)


@lru_cache(maxsize=4)
def together(ranks: bytes) -> bool:
    """Whether rows may merge all places of a pair at once; worked out on the driver, for tasks to be told."""
    return vocabulary(ranks, "").whole_tokens()


class Decoder:
    """The bytes of all tokens in a row, by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)


class Encoder:
    """Encodes texts, remembering the matches it has seen."""

    def __init__(self, own: Vocabulary) -> None:
        self.own = own
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.sizes, self.starts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        per_text = [self.own.pattern.findall(t) for t in texts]
        if len(self.seen) > CACHE:
            self._clear()
        flat = list(chain.from_iterable(per_text))
        new = list(set(flat).difference(self.seen))
        if new:
            places, sizes, ids = self.own.merge([p.encode() for p in new])
            self.seen.update(zip((new[i] for i in places.tolist()), range(len(self.seen), len(self.seen) + len(new))))
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.pool = np.concatenate([self.pool, ids])
        counts = np.array([len(p) for p in per_text], np.int64)
        which = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[which]
        ids = self.pool[_ranges(self.starts[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode(docs: DataFrame, ranks: bytes, pattern: str, out: str = "ids") -> DataFrame:
    """`docs` with the token ids of `text` (array of int) in column `out`, which replaces one of that name.

    The whole text is encoded; null counts as empty and gives no ids. Other columns and repeated rows are kept.
    """
    docs = docs.drop(out)
    text = docs.columns.index("text")
    at_once = together(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(ranks, pattern, at_once))
        for part in slices(batches, text, 600_000):
            ids, counts = encoder([t or "" for t in part.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))],
                [*part.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that the token ids in column `ids` stand for in column `out`; null ids give no bytes."""
    rows = rows.drop(out)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(parsed(ranks))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy().astype(np.int64)
                tokens = part.column(at).flatten().to_numpy(zero_copy_only=False)
                sizes = own.lengths[tokens]
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                flat = own.flat[_ranges(own.starts[tokens], sizes)].tobytes()
                texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("binary")).schema)


def id_digests(rows: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """`rows` with the SHA-256 of the decimal ids joined by one space in place of the ids."""
    return rows.withColumn(out, F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256)).drop(ids)
