"""Language identification by a byte convolutional network trained in numpy.

The network reads a fixed-length window of UTF-8 bytes: filters of several widths over one-hot bytes (so a convolution is a
sum of table rows), the maximum of each filter over all positions, ReLU, a linear layer and softmax. A text is cut into
windows that overlap by the widest filter less one byte, so no run of bytes is missed; the last one is padded with zero bytes. Its
probabilities are the mean over its windows, weighted by their bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packhouse.llm.folds import below, fit_in_one_task, held_out
from packhouse.llm.words import mix, slices, texts_of
from packhouse.sources.shared import materialize

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 12
STEP = WINDOW - max(WIDTHS) + 1
#: Most documents of a language, and windows of a document, that are fitted on.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1000, 3
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as a byte matrix, the text each belongs to, and its bytes of text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STEP)) // STEP))
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    lengths = np.minimum(WINDOW, sizes[owner] - starts)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    at = (np.cumsum(sizes) - sizes)[owner] + starts
    matrix = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[at]
    matrix[np.arange(WINDOW) >= lengths[:, None]] = 0
    return matrix, owner, lengths


def _pool(tables: list[np.ndarray], matrix: np.ndarray, places: bool = False):
    """Maximum of every filter over the positions, and on demand where it is."""
    best, where = [], []
    for table in tables:
        span = WINDOW - len(table) + 1
        total = table[0].take(matrix[:, :span], axis=0)
        for j in range(1, len(table)):
            total += table[j].take(matrix[:, j:j + span], axis=0)
        if places:
            where.append(total.argmax(axis=1))
        best.append(total.max(axis=1))
    return np.concatenate(best, axis=1), where


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def probabilities(model: dict[str, np.ndarray], matrix: np.ndarray, block: int = 256) -> np.ndarray:
    """Class probabilities of windows, in blocks so that memory does not grow with their number."""
    tables = [model[f"width{w}"] for w in WIDTHS]
    out = [np.zeros((0, len(model["bias"])), np.float32)]
    for i in range(0, len(matrix), block):
        pooled, _ = _pool(tables, matrix[i:i + block])
        out.append(_softmax(np.maximum(pooled + model["shift"], 0) @ model["dense"] + model["bias"]))
    return np.concatenate(out)


def fit_network(matrix: np.ndarray, classes: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Train by Adam on the mean cross-entropy, every class with the same total weight. Deterministic."""
    rng = np.random.default_rng(7)
    names = [f"width{w}" for w in WIDTHS]
    model = {n: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for n, w in zip(names, WIDTHS)}
    hidden = FILTERS * len(WIDTHS)
    model |= {"shift": np.zeros(hidden, np.float32), "bias": np.zeros(n_classes, np.float32),
              "dense": rng.normal(0, 0.3, (hidden, n_classes)).astype(np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    weight = (len(classes) / n_classes / np.maximum(np.bincount(classes, minlength=n_classes), 1)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(matrix))
        for i in range(0, len(order), BATCH):
            rows, goal = matrix[order[i:i + BATCH]], classes[order[i:i + BATCH]]
            pooled, where = _pool([model[n] for n in names], rows, places=True)
            active = np.maximum(pooled + model["shift"], 0)
            error = _softmax(active @ model["dense"] + model["bias"])
            error[np.arange(len(rows)), goal] -= 1
            error *= weight[goal][:, None] / len(rows)
            back = (error @ model["dense"].T) * (active > 0)
            slope = {"dense": active.T @ error, "bias": error.sum(0), "shift": back.sum(0)}
            for k, (n, w) in enumerate(zip(names, WIDTHS)):
                slope[n] = np.zeros_like(model[n])
                own = back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    seen = rows[np.arange(len(rows))[:, None], where[k] + j]
                    np.add.at(slope[n][j], (seen, np.arange(FILTERS)), own)
            step += 1
            for n, g in slope.items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                model[n] -= RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each text, drawn by a hash of id and place from all over it."""
    for part in slices(batches, text=2):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        matrix, owner, _ = windows(texts_of(part, 2))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = np.lexsort((mix(ids[owner].view(np.uint64) * np.uint64(1 << 20) + place.astype(np.uint64)), owner))
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        chosen = order[rank < SAMPLE_WINDOWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[owner[chosen]]), part.column(1).take(pa.array(owner[chosen])),
             pa.array([x.tobytes() for x in matrix[chosen]], pa.binary())], ["doc_id", "lang", "window"])


def _fit(sample: pa.Table) -> dict[str, np.ndarray]:
    rows = sorted(zip(sample["doc_id"].to_pylist(), sample["window"].to_pylist(), sample["lang"].to_pylist()))
    langs = sorted({r[2] for r in rows})
    if not langs:
        return {"langs": np.array([], "U1")}
    matrix = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    classes = np.array([langs.index(r[2]) for r in rows])
    return fit_network(matrix, classes, len(langs)) | {"langs": np.array(langs)}


def fit_language(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Fit on at most `per_language` documents of each language outside the held-out third.

    Rows without id, text or lang and texts without a letter are left out. Without any such row the model knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).filter(
        "doc_id is not null and lang is not null").filter(~held_out()).filter(F.col("text").rlike(r"\p{L}"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")

    def smallest(some: DataFrame) -> DataFrame:
        ranked = some.select("doc_id", "lang").withColumn("place", F.row_number().over(by_hash))
        return materialize(ranked.filter(F.col("place") <= per_language).drop("place"), "chosen")

    # Only rows whose hash can be among the smallest of their language are sorted, whatever the number of tasks. The model has a
    # class for each language, so the counts by language are no longer than the model.
    counts = {r.lang: r["count"] for r in docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).filter(
        "doc_id is not null and lang is not null").filter(~held_out()).groupBy("lang").count().collect()}
    if not counts:
        return _fit(pa.table({"doc_id": [], "window": [], "lang": []}))
    count = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    chosen = smallest(rows.filter(below(F.xxhash64("doc_id"), per_language, count)))
    full = {r.lang for r in chosen.groupBy("lang").count().filter(F.col("count") >= per_language).collect()}
    if any(n > 2 * per_language + 100 and lang not in full for lang, n in counts.items()):
        # Many texts without a letter: take all rows.
        chosen = smallest(rows)
    chosen = chosen.select("doc_id")
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id").mapInArrow(_drawn, "doc_id long, lang string, window binary")
    return fit_in_one_task(sample, _fit)


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (mean probability of lang_pred).

    Reads only `text`, all of it. Texts that are null or have no letter get `und` and score 0, as do all under a model that
    knows no language. Ties go to the language first in order. Repeated rows and rows without doc_id are answered too.
    """
    langs = [str(x) for x in model["langs"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            strings = part.column(1).to_pylist()
            known = [i for i, t in enumerate(strings) if langs and t and any(map(str.isalpha, t))]
            names, scores = [UNKNOWN] * len(strings), np.zeros(len(strings))
            if known:
                matrix, owner, lengths = windows([strings[i].encode() for i in known])
                share = probabilities(model, matrix) * lengths[:, None]
                total = np.add.reduceat(share, np.searchsorted(owner, np.arange(len(known))), axis=0)
                total /= total.sum(axis=1, keepdims=True)
                for i, best, row in zip(known, total.argmax(axis=1), total):
                    names[i], scores[i] = langs[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
