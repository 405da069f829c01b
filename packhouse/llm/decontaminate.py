"""Benchmark passages in documents, by SimHash over item-sized windows.

Words are in lower case with ASCII punctuation as white space; features are shingles of five words (a shorter item is one
shingle), weighted by how often they occur. A window has as many words as the item. Its SimHash is compared with the items of
its size through a multi-index: fingerprints are cut into blocks, and every item is listed under all block values within
floor(radius / blocks) bits of its own, so by the pigeonhole principle every item within the radius is listed in some
block. Each candidate is then verified by the exact weighted similarity of shingles, sum of minima over sum of maxima.

A window that shares no shingle with any item has similarity 0; such windows are not fingerprinted.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.llm.words import RangeHash, slices, texts_of, word_names

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCKS, BLOCK_BITS = 8, 8
#: Most items that one pass over the documents holds; more items take more passes.
ITEMS = 5000
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain(text: bytes) -> bytes:
    return text.lower().translate(_PLAIN)


def plain_words(text: bytes) -> list[bytes]:
    return plain(text).split()


def bag(words: list[bytes], size: int) -> Counter:
    return Counter(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags that are not both empty."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def simhash(bits: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of `count` shingles from each start on; `bits` are running sums of the 64 bits."""
    over = 2 * (bits[start + count] - bits[start]) > count
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def running_bits(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=out[1:])
    return out


class MultiIndex:
    """All fingerprints within `radius` bits of a query, found block by block."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        near = radius // BLOCKS
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
        # listed[block][value]: which items have a block within `near` bits of the value
        self.listed = [np.bitwise_count(values[:, None] ^ self._block(prints, b)[None, :]) <= near for b in range(BLOCKS)]

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) index pairs within the radius."""
        hit = np.zeros((len(queries), len(self.prints)), bool)
        for b in range(BLOCKS):
            hit |= self.listed[b][self._block(queries, b).astype(np.int64)]
        query, item = np.nonzero(hit)
        close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
        return query[close], item[close]


class Items:
    """The items of one pass: shingles, and a multi-index for each size."""

    def __init__(self, rows: list[tuple[int, str]], radius: int) -> None:
        self.by_size: dict[tuple[int, int], tuple] = {}
        groups: dict[tuple[int, int], list] = defaultdict(list)
        for item, text in rows:
            words = plain_words((text or "").encode())
            if words:
                groups[min(SHINGLE, len(words)), len(words)].append((item, words))
        known: dict[int, list[np.ndarray]] = defaultdict(list)
        #: Which sizes have an item with this shingle.
        self.sizes: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for (shingle, n), members in groups.items():
            prints = []
            for _, words in members:
                h = _shingle_hashes(word_names([b" ".join(words)])[0], shingle)
                known[shingle].append(h)
                for x in h.tolist():
                    self.sizes[x].add((shingle, n))
                prints.append(simhash(running_bits(h), np.array([0]), len(h))[0])
            self.by_size[shingle, n] = ([i for i, _ in members], [bag(w, shingle) for _, w in members],
                                        MultiIndex(np.array(prints, np.uint64), radius))
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.filters = {k: self._filter(v) for k, v in self.known.items()}

    @staticmethod
    def _filter(known: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 22, bool)
        table[(known >> np.uint64(42)).astype(np.int64)] = True
        return table

    def shared(self, h: np.ndarray, shingle: int) -> np.ndarray:
        """Places of shingles that some item has."""
        maybe = np.flatnonzero(self.filters[shingle][(h >> np.uint64(42)).astype(np.int64)])
        return maybe[np.isin(h[maybe], self.known[shingle])]


def _shingle_hashes(h: np.ndarray, shingle: int) -> np.ndarray:
    start = np.arange(len(h) - shingle + 1)
    return RangeHash(h)(start, start + shingle)


def _windows_of(places: np.ndarray, shingles: int, last: int) -> np.ndarray:
    """Starts of windows of `shingles` shingles that have one of the places; `last` is the largest start."""
    starts = np.unique((places[:, None] - np.arange(shingles)[None, :]).ravel())
    return starts[(starts >= 0) & (starts <= last)]


def _matches(words: list[bytes], places: dict[tuple[int, int], list[int]], items: Items, least: float) -> Iterator[tuple]:
    """(item, similarity, start, words, distance) of the best window for each item found in one text."""
    h = word_names([b" ".join(words)])[0]
    for (shingle, n), at_places in places.items():
        ids, bags, index = items.by_size[shingle, n]
        # A text shorter than the item is one window.
        size = min(n, len(words))
        count = size - shingle + 1
        starts = _windows_of(np.array(at_places), count, len(words) - size)
        low, high = int(starts[0]), int(starts[-1]) + size
        bits = running_bits(_shingle_hashes(h[low:high], shingle))
        best: dict[int, tuple] = {}
        for at in range(0, len(starts), 4096):
            some = starts[at:at + 4096]
            prints = simhash(bits, some - low, count)
            for q, i in zip(*index(prints)):
                start = int(some[q])
                found = similarity(bag(words[start:start + size], shingle), bags[i])
                if found >= least and (i not in best or found > best[i][1]):
                    distance = int(np.bitwise_count(prints[q] ^ index.prints[i]))
                    best[i] = (ids[i], found, start, size, distance)
        yield from best.values()


def _searched(items: Items, least: float, part: pa.RecordBatch, text: int) -> Iterator[tuple[int, tuple]]:
    """(row, match) for all matches in a slice."""
    texts = texts_of(part, text)
    h, n = word_names([plain(t) for t in texts])
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), n)
    found: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    for shingle in items.known:
        if len(h) < shingle:
            continue
        shingled = _shingle_hashes(h, shingle)
        places = items.shared(shingled, shingle)
        places = places[owner[places] == owner[places + shingle - 1]]
        rows = owner[places]
        for row, place, x in zip(rows.tolist(), (places - first[rows]).tolist(), shingled[places].tolist()):
            for size in items.sizes[x]:
                found[row][size].append(place)
    for row in sorted(found):
        for match in _matches(plain_words(texts[row]), found[row], items, least):
            yield row, match


def _passes(benchmark: DataFrame, radius: int, items: int) -> Iterator[Items]:
    """The benchmark in blocks of about `items`, each small enough for the driver and every task."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    blocks = -(-rows.count() // items)
    for b in range(blocks):
        yield Items([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()], radius)


def contaminations(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS,
                   items: int = ITEMS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, start, n_words, distance.

    start and n_words name the best window in the document's plain words (ties: the first); distance is that of the
    fingerprints. Null and blank texts and items have no words and never match; a repeated row of either table
    repeats its rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, similarity double, start int, n_words int, distance int"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = list(_searched(block, least, part, 1))
                columns = list(zip(*(m for _, m in rows))) or [()] * 5
                kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([r for r, _ in rows], pa.int64())),
                     *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["doc_id", "item_id", "similarity", "start", "n_words", "distance"])
        return run

    out = None
    for block in _passes(benchmark, radius, items):
        found = texts.mapInArrow(search(block), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS,
                         items: int = ITEMS) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item is found."""
    text = docs.columns.index("text")

    def keep(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                kept = np.ones(part.num_rows, bool)
                kept[[row for row, _ in _searched(block, least, part, text)]] = False
                yield part.filter(pa.array(kept))
        return run

    for block in _passes(benchmark, radius, items):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
