"""Chat formatting at the level of tokens: conversations as token ids with a loss mask, and back.

Roles and texts are segments that are encoded one by one, so that no token reaches from one into the next. Reserved ids, above
those of the vocabulary, are spliced between them; they are the only place where turns are marked, and a text cannot produce
them. The loss mask is a prefix sum over +1 where a learned text begins and -1 where it ends. So that the rendered string can be
parsed too, control strings that occur in a role or text are escaped by a backslash after their first character, and those that
already have backslashes there get one more; `unescape` takes it away again.

A conversation is one row, unless its texts have more than `piece_bytes` bytes: then it comes as several rows, numbered by
`piece`, so that no task holds a whole giant. Pieces are cut between turns.

Rows are taken in the order of `turn` (nulls first), rows of one turn in that of role and text; repeated rows are kept. A null
role or text counts as empty. Rows without `conv_id` are one conversation, whose id is null. Other columns are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.llm.bpe import Encoder, _ranges, parsed, together, vocabulary
from packhouse.llm.words import slices
from packhouse.operators.numbering import running_totals
from packhouse.sources.shared import materialize

#: Bytes of texts from which a conversation is cut into pieces.
PIECE_BYTES = 16_000_000
SLICE_BYTES = 400_000
FORMATTED = "conv_id {}, piece long, pieces long, ids array<int>, loss_mask array<boolean>"


@dataclass(frozen=True)
class Template:
    """What marks turns: `begin` once, then per turn `turn` role `text` text `end`. Texts of `learned` roles get the loss.

    A control string's first character occurs nowhere else in any of them, so that occurrences never overlap.
    """

    begin: str = "<s>"
    turn: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.marks
        heads = {m[:1] for m in marks}
        if len(set(marks)) < len(marks) or any(
                len(m) < 2 or "\\" in m or heads & set(m[1:]) or any(m != o and o.startswith(m) for o in marks) for m in marks):
            raise ValueError(f"control strings that can be mistaken for one another: {marks}")

    @property
    def marks(self) -> tuple[str, str, str, str]:
        return self.begin, self.turn, self.text, self.end

    def _pattern(self, slashes: str) -> regex.Pattern:
        return regex.compile("|".join(f"(?<={regex.escape(m[0])}){slashes}(?={regex.escape(m[1:])})" for m in self.marks))

    def escaper(self):
        """Text to text without control strings."""
        found, heads = self._pattern(r"\\*"), regex.compile("[" + "".join(regex.escape(m[0]) for m in self.marks) + "]")
        return lambda t: found.sub(lambda m: m.group() + "\\", t) if heads.search(t) else t

    def unescaper(self):
        """What undoes `escaper`."""
        found = self._pattern(r"\\+")
        return lambda t: found.sub(lambda m: m.group()[1:], t) if "\\" in t else t


def _pieces(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """`rows` (conv_id, turn, role, text, _bytes) with `piece` and `pieces`: 0 and 1 but for giants.

    Giants are found by summed lengths. Their rows alone are sorted by range and summed up across tasks, which cuts them at
    multiples of `piece_bytes` without any task that sees all of one.
    """
    sums = rows.groupBy("conv_id").agg(F.sum("_bytes").alias("_sum")).filter(F.col("_sum") > piece_bytes)
    giants = materialize(sums.select(F.col("conv_id").alias("_giant")), "giants")
    if giants.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long")).withColumn("pieces", F.lit(1).cast("long"))
    same = F.col("conv_id").eqNullSafe(F.col("_giant"))
    summed = running_totals(
        rows.join(giants, same, "left_semi"), ["conv_id", "turn", "role", "text"], {"_so_far": F.col("_bytes")})
    cut = materialize(summed.withColumn("_cut", F.floor((F.col("_so_far") - F.col("_bytes")) / piece_bytes)), "cut")
    firsts = materialize(
        cut.groupBy(F.col("conv_id").alias("_giant")).agg(
            F.min("_cut").alias("_first"), F.max("_cut").alias("_last")), "firsts")
    placed = cut.join(firsts, same).select(
        *rows.columns, (F.col("_cut") - F.col("_first")).alias("piece"), (F.col("_last") - F.col("_first") + 1).alias("pieces"))
    others = rows.join(giants, same, "left_anti")
    return placed.unionByName(others.select("*", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces")))


class _Assembler:
    """Turns of sorted rows to ids and masks; conversations may go on from one batch to the next."""

    def __init__(self, encoder: Encoder, template: Template, reserved: int) -> None:
        self.encoder, self.template, self.escape = encoder, template, template.escaper()
        self.begin, self.turn, self.text, self.end = range(reserved, reserved + 4)

    def __call__(self, roles: list[str], texts: list[str], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the mask, and the number of ids of each turn; `opens` marks the turns that begin a conversation."""
        segments = [self.escape(s) for pair in zip(roles, texts) for s in pair]
        ids, counts = self.encoder(segments)
        role, text = counts[::2], counts[1::2]
        sizes = opens + role + text + 3
        ends = np.cumsum(sizes)
        at = ends - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[at[opens]] = self.begin
        marks = at + opens
        out[marks] = self.turn
        out[marks + 1 + role] = self.text
        out[ends - 1] = self.end
        starts = np.empty(2 * len(sizes), np.int64)
        starts[::2], starts[1::2] = marks + 1, marks + 2 + role
        out[_ranges(starts, counts)] = ids
        learned = np.fromiter((r in self.template.learned for r in roles), bool, len(roles))
        steps = np.zeros(len(out) + 1, np.int8)
        np.add.at(steps, starts[1::2][learned], 1)
        np.add.at(steps, (ends - 1)[learned], -1)
        return out, np.cumsum(steps[:-1], dtype=np.int8).astype(bool), sizes


def reserved_ids(ranks: bytes) -> int:
    """The first id above those of a vocabulary; the four reserved ids begin here."""
    return max(parsed(ranks).values()) + 1


def format_chats(
    conversations: DataFrame, ranks: bytes, pattern: str, template: Template = Template(), piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per conversation, or per piece of a giant one: conv_id, piece (from 0), pieces, ids, loss_mask."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sized = rows.withColumn("_bytes", (F.octet_length("text") + F.octet_length("role") + 1).cast("long"))
    placed = _pieces(sized, piece_bytes).select("conv_id", "piece", "pieces", "turn", "role", "text")
    kind = placed.schema["conv_id"].dataType.simpleString()
    at_once = together(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assemble = _Assembler(Encoder(vocabulary(ranks, pattern, at_once)), template, reserved_ids(ranks))
        held, last = None, None

        def rows_of(keys: list, ids: list, masks: list) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((key_type, pa.int64(), pa.int64()))]
            for parts, value in ((ids, pa.int32()), (masks, pa.bool_())):
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), value)))
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "pieces", "ids", "loss_mask"])

        for part in slices(batches, 5, SLICE_BYTES):
            key_type = part.column(0).type
            keys = list(zip(*(part.column(i).to_pylist() for i in range(3))))
            new = np.array([k != p for k, p in zip(keys, [last, *keys[:-1]])])
            opens = new & np.array([k[1] == 0 for k in keys])
            ids, mask, sizes = assemble(part.column(4).to_pylist(), part.column(5).to_pylist(), opens)
            cuts = (np.cumsum(sizes) - sizes)[new]
            some_ids, some_masks = np.split(ids, cuts), np.split(mask, cuts)
            if held:
                held[1].append(some_ids[0])
                held[2].append(some_masks[0])
            if new.any():
                fresh = [k for k, n in zip(keys, new) if n]
                done = [(held[0], np.concatenate(held[1]), np.concatenate(held[2]))] if held else []
                done += zip(fresh[:-1], some_ids[1:-1], some_masks[1:-1])
                if done:
                    yield rows_of(*map(list, zip(*done)))
                held = fresh[-1], [some_ids[-1]], [some_masks[-1]]
            last = keys[-1]
        if held:
            yield rows_of([held[0]], [np.concatenate(held[1])], [np.concatenate(held[2])])

    ordered = placed.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role", "text")
    return ordered.mapInArrow(run, FORMATTED.format(kind))


class _Reader:
    """What ids stand for, reserved ones included."""

    def __init__(self, ranks: bytes, template: Template) -> None:
        known = parsed(ranks)
        self.first = max(known.values()) + 1
        tokens = [b""] * self.first
        for token, rank in known.items():
            tokens[rank] = token
        tokens += [m.encode() for m in template.marks]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end."""
        sizes = self.lengths[ids]
        return self.flat[_ranges(self.starts[ids], sizes)].tobytes(), np.cumsum(sizes)


def read_chats(formatted: DataFrame, ranks: bytes, template: Template = Template()) -> DataFrame:
    """What the ids of formatted rows say: conv_id, piece, pieces, `turns` (array of role and text, unescaped), `learned` (the
    texts under the loss mask, joined), and `rendered`, the formatted string with its control strings."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, unescape = _Reader(ranks, template), template.unescaper()
        turn, text, end = reader.first + 1, reader.first + 2, reader.first + 3

        def read(ids: np.ndarray, mask: np.ndarray) -> tuple[list, str, str]:
            raw, ends = reader(ids)
            ends = np.concatenate([[0], ends])

            def between(starts: np.ndarray, stops: np.ndarray) -> list[str]:
                return [unescape(raw[a:b].decode()) for a, b in zip(ends[starts + 1].tolist(), ends[stops].tolist())]

            turns, texts, stops = (np.flatnonzero(ids == x) for x in (turn, text, end))
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            # Runs under the mask are single texts: a reserved id parts any two.
            learned = "".join(between(edges[::2] - 1, edges[1::2]))
            pairs = zip(between(turns, texts), between(texts, stops))
            return [{"role": r, "text": t} for r, t in pairs], learned, raw.decode()

        said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [read(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False))
                         for ids, mask in zip(part.column(3), part.column(4))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([f[0] for f in found], said),
                     pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                    ["conv_id", "piece", "pieces", "turns", "learned", "rendered"])

    return formatted.select("conv_id", "piece", "pieces", "ids", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, piece long, pieces long, turns array<struct<role string, text string>>, "
             "learned string, rendered string")


def _said() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")


DIGESTS = ("conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(read: DataFrame) -> DataFrame:
    """Per conversation the number of turns, the digest of all of them, length and digest of the learned texts, and the length
    of the formatted string.

    Whole conversations are digested where they are read. Pieces of giants are hashed one after the other, in order: SHA-256
    of one conversation cannot be split, but only one piece is held at a time.
    """
    kind = read.schema["conv_id"].dataType.simpleString()
    said = read.select("conv_id", "piece", "pieces", F.size("turns").cast("long").alias("n_turns"), _said().alias("said"),
                       "learned", F.char_length("rendered").cast("long").alias("formatted_chars"))
    chars = F.char_length("learned").cast("long")
    whole = said.filter("pieces = 1").select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), chars.alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def row(key, key_type, n, turns, chars, loss, formatted) -> pa.RecordBatch:
            values = [n, turns.hexdigest(), chars, loss.hexdigest(), formatted]
            return pa.RecordBatch.from_arrays(
                [pa.array([key], key_type), *(pa.array([v], k) for v, k in zip(values, kinds))], names)

        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if state is None or r["conv_id"] != state[0]:
                    if state:
                        yield row(*state)
                    state = [r["conv_id"], batch.schema.field("conv_id").type, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[2] += r["n_turns"]
                state[3].update(r["said"].encode())
                state[4] += len(r["learned"])
                state[5].update(r["learned"].encode())
                state[6] += r["formatted_chars"]
        if state:
            yield row(*state)

    giants = said.filter("pieces > 1").drop("pieces").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(giants.mapInArrow(run, DIGESTS.format(kind)))
