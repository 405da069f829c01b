"""Repeated word sequences across documents, found by recompression.

Naming. The words of a text are recompressed in rounds. A round joins every adjacent pair whose first symbol falls on the left
and whose second on the right of a two-way split of all symbols, and then every run of one symbol. A symbol's name is a 64-bit
hash of what it joins, and the split is a bit of that hash, so all tasks of all rounds give one name to equal content
without a dictionary. Each symbol carries the span of words that decides it (its own, and the neighbours it was compared with);
a symbol is interior to a window if this span is. Equal windows therefore have equal interior symbols in equal places.

Revealing. A window is represented by its highest interior symbol (ties: smallest name, then first). Consecutive windows of one
text with one representative form a unit with two names: the words of the deciding span, and all words of its windows.
Spark counts the first; windows of a unit whose first name occurs once in the corpus are unique. For the others, Spark finds the
first document of each second name: all windows of the other occurrences are repeats.

Verifying. First units whose first name comes with several second names may share some windows only (ends of a passage). Just
these are taken window by window: the first document of each window's words decides.

Only names and ids travel, and all groupings are mergeable minima and counts; what a document learns is keyed by the document.
Texts are moved at the last two steps, by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.llm.words import MIX_1, MIX_2, MIX_3, RangeHash, mix, slices, texts_of, word_names
from packhouse.sources.shared import materialize

WINDOW = 20
SLICE = 400_000
FAR = 1 << 40


class _Round:
    """A sequence of symbols: names, the words they cover (start, end), and the words that decide them (low, high)."""

    def __init__(self, name, start, end, low, high) -> None:
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def kept(self, mask: np.ndarray) -> _Round:
        return _Round(*(x[mask] for x in (self.name, self.start, self.end, self.low, self.high)))

    def pairs(self, salt: int) -> tuple[_Round, np.ndarray]:
        """Join left-right pairs. The second result marks the joined symbols."""
        right = (mix(self.name + np.array(salt, np.uint64) * MIX_2) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(right), bool)
        joins[:-1] = ~right[:-1] & right[1:]
        gone = np.zeros(len(right), bool)
        gone[1:] = joins[:-1]
        out = _Round(self.name.copy(), self.start.copy(), self.end.copy(), self.low.copy(), self.high.copy())
        a = np.flatnonzero(joins)
        out.name[a] = mix(self.name[a] * MIX_1 + mix(self.name[a + 1] + MIX_3))
        out.end[a] = self.end[a + 1]
        out.low[a] = np.minimum(self.low[a], self.low[a + 1])
        out.high[a] = np.maximum(self.high[a], self.high[a + 1])
        # A symbol stays alone because of the neighbour on its open side.
        alone = ~joins & ~gone
        for side, step in ((alone & ~right, 1), (alone & right, -1)):
            at = np.flatnonzero(side)
            out._see(at, at + step, self)
        keep = ~gone
        return out.kept(keep), joins[keep]

    def runs(self) -> tuple[_Round, np.ndarray]:
        """Join runs of one symbol. The second result marks the joined symbols."""
        first = np.ones(len(self.name), bool)
        first[1:] = self.name[1:] != self.name[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(first)))
        out = _Round(np.where(size > 1, mix(self.name[at] * MIX_2 + size.astype(np.uint64)), self.name[at]),
                     self.start[at], self.end[at + size - 1],
                     np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at))
        # A run ends, and a single symbol is single, because the symbols beside it differ.
        every = np.arange(len(at))
        out._see(every, at + size, self)
        out._see(every, at - 1, self)
        return out, size > 1

    def _see(self, at: np.ndarray, near: np.ndarray, of: _Round) -> None:
        """Add to the deciding spans of symbols `at` those of their neighbours; beyond an end there is none."""
        n = len(of.name)
        inside = (near >= 0) & (near < n)
        a, b = at[inside], near[inside]
        self.low[a] = np.minimum(self.low[a], of.low[b])
        self.high[a] = np.maximum(self.high[a], of.high[b])
        self.low[at[near < 0]] = -FAR
        self.high[at[near >= n]] = FAR


def representatives(words: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the span (low, high) of words that decides its highest interior symbol.

    `words` are names of words, with a name of its own between texts; `valid` marks the starts of windows within one text.
    Only symbols decided by at most 2/5 of a window count, so that one stands for many windows. A window without such a
    symbol is represented by all its words.
    """
    n, widest = len(words), max(2, 2 * window // 5)
    place = np.arange(n, dtype=np.int64)
    now = _Round(words, place, place + 1, place, place + 1)
    best = np.zeros(n, np.uint64)
    low, high, level = [place[:0]], [place[:0]], 0
    value = [best[:0]]
    while len(now.name) > 1 and level < 15:
        level += 1
        for step in (lambda r: r.pairs(level), _Round.runs):
            now, joined = step(now)
            fits = joined & (now.low >= 0) & (now.high - now.low <= widest)
            low.append(now.low[fits])
            high.append(now.high[fits])
            value.append((np.uint64(level) << np.uint64(60)) | (~now.name[fits] >> np.uint64(4)))
        if not (now.high - now.low <= widest).any():
            break
    low, high, value = map(np.concatenate, (low, high, value))
    # Symbol i is interior to the windows that start from high - window to low.
    first = np.maximum(high - window, 0)
    owner = np.full(n, len(low), np.int64)
    order = np.lexsort((low, ~value))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for j in range(window):
        some = np.flatnonzero(first + j <= low)
        np.minimum.at(owner, first[some] + j, rank[some])
    owner = owner[:n]
    has = owner < len(low)
    own_low, own_high = place.copy(), place + window
    chosen = order[owner[has]]
    own_low[has], own_high[has] = low[chosen], high[chosen]
    return np.where(valid, own_low, -1), np.where(valid, own_high, -1)


class Units:
    """The windows of some texts, as units of consecutive windows with one representative."""

    def __init__(self, texts: list[bytes], window: int = WINDOW) -> None:
        self.window = window
        own, self.counts = word_names(texts)
        self.offsets = np.cumsum(self.counts + 1) - (self.counts + 1)
        total = int((self.counts + 1).sum())
        names = mix(np.arange(total, dtype=np.uint64) + MIX_3)
        in_text = np.ones(total, bool)
        in_text[self.offsets + self.counts] = False
        names[in_text] = own
        owner = np.repeat(np.arange(len(texts)), self.counts + 1)
        valid = np.arange(total) - self.offsets[owner] <= self.counts[owner] - window
        low, high = representatives(names, valid, window)
        self.ranges = RangeHash(names)
        starts = np.flatnonzero(valid)
        new = np.ones(len(starts), bool)
        new[1:] = ((low[starts[1:]] != low[starts[:-1]]) | (high[starts[1:]] != high[starts[:-1]])
                   | (starts[1:] != starts[:-1] + 1))
        at = np.flatnonzero(new)
        self.start = starts[at]
        self.stop = starts[np.append(at[1:], len(starts)) - 1] + 1 if len(at) else starts[at]
        self.row = owner[self.start]
        self.core = self.ranges(low[self.start], high[self.start])
        place = (low[self.start] - self.start).astype(np.uint64)
        self.whole = mix(self.ranges(self.start, self.stop + window - 1) + place * MIX_1)

    def windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, names and units of the windows of the given units."""
        size = self.stop[units] - self.start[units]
        ends = np.cumsum(size)
        at = np.repeat(self.start[units] - (ends - size), size) + np.arange(int(size.sum()))
        return at, self.ranges(at, at + self.window), np.repeat(units, size)


def _counted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each distinct row, and how often it occurs."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return np.minimum.reduceat(order, at), np.diff(np.append(at, len(order)))


def _distinct(*columns: np.ndarray) -> np.ndarray:
    return _counted(*columns)[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _units(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE):
            units = Units(texts_of(part), window)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            at, times = _counted(ids[units.row], units.core, units.whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[units.row[at]]), _signed(units.core[at]), _signed(units.whole[at]), pa.array(times)],
                ["doc_id", "core", "whole", "times"])
    return run


def _list(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    column = part.column(part.schema.get_field_index(name))
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(counts)), counts)


def _member(rows: np.ndarray, names: np.ndarray, of_rows: np.ndarray, of_names: np.ndarray) -> np.ndarray:
    """Which (row, name) are among (of_rows, of_names)."""
    key = np.concatenate([rows, of_rows]), np.concatenate([names, of_names])
    order = np.lexsort(key[::-1])
    group = np.ones(len(order), np.int64)
    if len(order):
        group[0] = 0
        group[1:] = (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1])
    label = np.empty(len(order), np.int64)
    label[order] = np.cumsum(group)
    return np.isin(label[:len(rows)], label[len(rows):])


class _Told:
    """Units of a slice with what is known of them: `repeated`, and of these `first` and `mixed` (to be taken by windows)."""

    def __init__(self, part: pa.RecordBatch, texts: list[bytes], window: int) -> None:
        self.units = units = Units(texts, window)
        self.repeated = _member(units.row, units.whole, *_swap(_list(part, "__repeated")))
        told_first = _member(units.row, units.whole, *_swap(_list(part, "__first")))
        self.mixed = _member(units.row, units.whole, *_swap(_list(part, "__mixed")))
        # The first of equal units of the text.
        earliest = np.zeros(len(units.row), bool)
        earliest[_distinct(units.row, units.core, units.whole)] = True
        self.first = told_first & earliest
        self.mixed &= self.first


def _swap(pair: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return pair[1], pair[0]


def _single_windows(window: int):
    """Windows of units that are to be taken by windows, once per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE // 3):
            told = _Told(part, _unpacked(part, 1), window)
            _, names, unit = told.units.windows(np.flatnonzero(told.mixed))
            rows, cores = told.units.row[unit], told.units.core[unit]
            at = _distinct(rows, cores, names)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows[at]]), _signed(cores[at]), _signed(names[at])], ["doc_id", "core", "name"])
    return run


def _covered(part: pa.RecordBatch, texts: list[bytes], window: int) -> tuple[Units, np.ndarray]:
    """Which words (in the numbering of Units) lie in a window that starts earlier too."""
    told = _Told(part, texts, window)
    units = told.units
    at, _, _ = units.windows(np.flatnonzero(told.repeated & ~told.first))
    single, names, unit = units.windows(np.flatnonzero(told.mixed))
    rows = units.row[unit]
    first = _member(rows, names, *_swap(_list(part, "__windows")))
    earliest = np.zeros(len(rows), bool)
    earliest[_distinct(rows, units.core[unit], names)] = True
    at = np.concatenate([at, single[~(first & earliest)]])
    change = np.zeros(int((units.counts + 1).sum()) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return units, np.cumsum(change) > 0


def _pack(text: int):
    """Texts as compressed bytes, so that their way through a shuffle costs less disk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches, text, SLICE):
            packed = [None if x is None else pack(x) for x in part.column(text).cast(pa.binary()).to_pylist()]
            yield part.set_column(text, part.schema.names[text], pa.array(packed, pa.binary()))
    return run


def _unpacked(part: pa.RecordBatch, text: int) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else unpack(x) for x in part.column(text).to_pylist()]


def _cut(columns: list[str], text: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE // 3):
            texts = _unpacked(part, text)
            units, gone = _covered(part, texts, window)
            removed, kept = [], []
            for t, offset, n in zip(texts, units.offsets.tolist(), units.counts.tolist()):
                own = gone[offset:offset + n]
                removed.append(int(own.sum()))
                kept.append(b" ".join([w for w, g in zip(t.split(), own.tolist()) if not g] if removed[-1] else t.split()))
            own = {c: part.column(part.schema.get_field_index(c)) for c in columns}
            own[columns[text]] = pa.array([None if x is None else t for x, t in zip(
                part.column(text).to_pylist(), texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*own.values(), pa.array(units.counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [*columns, "n_words", "n_removed", "kept"])
    return run


def _packed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_pack(docs.columns.index("text")), docs.withColumn("text", F.col("text").cast("binary")).schema)


#: Columns that are joined to the documents on the way.
JOINED = {"__id", "__repeated", "__first", "__mixed", "__windows"}


def _set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns of these names, in whatever case, under fresh names; and how those are renamed back."""
    taken, back = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names:
            fresh = next(n for i in count() if (n := f"__own{i}") not in taken)
            taken.add(fresh)
            back[fresh] = c
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_removed and kept: the words left, joined by one space, after removing every word of a
    window of `window` words whose word sequence also starts earlier (smaller doc_id, or the same document earlier).

    Windows are judged on the input. Whole texts are used; null and blank texts have no words, and texts shorter than
    the window lose none. Rows without doc_id come after all others, as one document each with nothing known of the others: they
    are returned uncut and cut nothing. Rows that repeat a doc_id count as one document at one place, so each loses what an
    earlier document has; ids are meant to be unique. Other columns are kept; n_words, n_removed, kept replace columns so named.
    """
    docs, back = _set_aside(docs.drop("n_words", "n_removed", "kept"), JOINED)
    columns = docs.columns
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    units = texts.mapInArrow(_units(window), "doc_id long, core long, whole long, times long")
    repeated = units.groupBy("core").agg(F.sum("times").alias("n")).filter("n > 1").select("core")
    # Written, so that a join with a name that very many units have is between two plain shuffles and can be split.
    repeated = materialize(repeated, "repeated")
    shared = materialize(units.join(repeated, "core", "left_semi").drop("times"), "units")
    first = shared.groupBy("core", "whole").agg(F.min("doc_id").alias("doc_id"))
    mixed = first.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core", F.lit(True).alias("mixed"))
    first = first.join(materialize(mixed, "mixed"), "core", "left").select("doc_id", "whole", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    facts = shared.select("doc_id", "whole", F.lit(0).alias("kind")).unionByName(
        first.select("doc_id", "whole", F.when(F.col("mixed"), 2).otherwise(1).alias("kind")))
    told = materialize(facts.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("kind") == 0, F.col("whole"))).alias("__repeated"),
        F.collect_list(F.when(F.col("kind") > 0, F.col("whole"))).alias("__first"),
        F.collect_list(F.when(F.col("kind") == 2, F.col("whole"))).alias("__mixed")), "told")
    singles = _packed(texts).join(told.filter(F.size("__mixed") > 0), "doc_id").mapInArrow(
        _single_windows(window), "doc_id long, core long, name long")
    wins = singles.groupBy("core", "name").agg(F.min("doc_id").alias("doc_id"))
    wins = wins.groupBy("doc_id").agg(F.collect_list("name").alias("__windows"))
    known = told.join(wins, "doc_id", "left").withColumnRenamed("doc_id", "__id")
    joined = _packed(docs).join(known, F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    schema = docs.selectExpr("*", "0L as n_words", "0L as n_removed", "'' as kept").schema
    return joined.mapInArrow(_cut(columns, columns.index("text"), window), schema).withColumnsRenamed(back)


def kept_digest(kept: str = "kept") -> Column:
    """SHA-256 of the kept words, in lower-case hex."""
    return F.sha2(F.col(kept).cast("binary"), 256)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs`, with all their columns, without repeated words; a document that loses all its words goes.

    A text that loses words becomes the others, joined by one space, and n_chars, if there, its new length; other texts stay
    as they are.
    """
    aside, back = _set_aside(docs, {"n_words", "n_removed", "kept"})
    found = without_repeats(aside, window)
    found = found.filter("n_removed = 0 or n_removed < n_words").withColumn(
        "text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return found.drop("n_words", "n_removed", "kept").withColumnsRenamed(back).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema])
