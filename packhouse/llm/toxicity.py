"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, and pairs with one or two words left out between
them, in lower case and with ASCII punctuation as white space. Each coordinate has its own learning rate, and L1 keeps only
coordinates with steady evidence, so the fitted model is a short list of (index, weight) that is sent to all tasks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.llm.folds import fit_in_one_task, held_out, smallest_hashes
from packhouse.llm.words import MIX_1, mix, slices, texts_of, word_names

DIMENSION_BITS = 22
#: Most labelled documents of a class that are fitted on. A bound of the sample, not of what is scored.
SAMPLE = {1: 4000, 0: 6000}
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 4.0, 0.0, 6
THRESHOLD = 0.7
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def coordinates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of all texts, distinct per text and sorted, and the number of each text's."""
    h, n = word_names([t.lower().translate(_PLAIN) for t in texts])
    doc = np.repeat(np.arange(len(texts)), n)
    parts, owners = [h], [doc]
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:]
        parts.append(mix(h[:-gap] * MIX_1 + h[gap:] + np.uint64(gap))[same])
        owners.append(doc[gap:][same])
    index = np.concatenate(parts) >> np.uint64(64 - DIMENSION_BITS)
    keys = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(DIMENSION_BITS)) | index)
    return ((keys & np.uint64((1 << DIMENSION_BITS) - 1)).astype(np.int32),
            np.bincount((keys >> np.uint64(DIMENSION_BITS)).astype(np.int64), minlength=len(texts)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights after `epochs` passes in the given order. The last coordinate is the constant."""
    size = (1 << DIMENSION_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for row, y in zip(rows, labels):
            at = np.append(row, size - 1)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = _sigmoid(w.sum()) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return {"index": kept.astype(np.int32), "weight": w[kept]}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, text=2):
        index, counts = coordinates(texts_of(part, 2))
        packed = [x.tobytes() for x in np.split(index, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())],
                                         ["doc_id", "label", "features"])


def _fit(sample: pa.Table) -> dict[str, np.ndarray]:
    ids = np.array(sample["doc_id"].to_pylist(), np.int64)
    order = np.lexsort((np.arange(len(ids)), ids, mix(ids.view(np.uint64))))
    # Views of the column's own memory, which is the only copy of the features.
    features = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["features"]]
    labels = sample["label"].to_pylist()
    return fit_ftrl([features[i] for i in order], np.array([labels[i] for i in order], float))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> dict[str, np.ndarray]:
    """Fit on labelled documents outside the held-out third, at most `sample[label]` of a class.

    Labels other than 0 and 1 and rows without id are left out; an id labelled both ways counts as 1. With no labelled
    document the model is empty and every score 0.5.
    """
    sample = sample or SAMPLE
    known = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
             .filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
             .filter(~held_out()))
    chosen = smallest_hashes(known.filter("label = 1"), sample[1]).unionByName(
        smallest_hashes(known.filter("label = 0"), sample[0]))
    # At most sum(sample) rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    return fit_in_one_task(rows.mapInArrow(_featured, "doc_id long, label int, features binary"), _fit)


def _dense(model: dict[str, np.ndarray]) -> np.ndarray:
    dense = np.zeros((1 << DIMENSION_BITS) + 1, np.float32)
    dense[model["index"]] = model["weight"]
    return dense


def _score(dense: np.ndarray, texts: list[bytes]) -> np.ndarray:
    index, counts = coordinates(texts)
    sums = np.concatenate([[0.0], np.cumsum(dense[index], dtype=np.float64)])
    ends = np.cumsum(counts)
    return _sigmoid(sums[ends] - sums[ends - counts] + dense[-1])


def toxicity_scores(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (1 if score >= threshold).

    Reads only `text`. Null and blank texts get the score of the constant alone. Repeated rows and rows without doc_id are
    scored too; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(model)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_score(dense, texts_of(part)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below the threshold."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(model)
        for part in slices(batches, text):
            yield part.filter(pa.array(_score(dense, texts_of(part, text)) < threshold))

    return docs.mapInArrow(run, docs.schema)
