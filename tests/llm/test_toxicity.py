import math
import random
import zlib

import numpy as np
import pytest

from packhouse.llm import toxicity
from packhouse.llm.folds import held_out

ROWS = "doc_id long, text string, score string"


def corpus(n=900):
    pick = random.Random(9)
    clean, rude = [f"w{i}" for i in range(300)], ["scum", "Moron", "ÄrGer", "trash,"]
    docs, labels = [], []
    for i in range(n):
        words = pick.choices(clean, k=pick.choice([20, 100]))
        toxic = int(pick.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(pick.randrange(len(words)), pick.choice(rude))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, toxic, "y"))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, ROWS)
    model = toxicity.fit_toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    return docs, labels, frame, model


def test_held_out_documents_are_told_apart(fitted):
    docs, labels, frame, model = fitted
    scores = {r.doc_id: r for r in toxicity.toxicity_scores(frame, model).collect()}
    assert len(scores) == len(docs) and len(model["index"]) < 2000
    out = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(out) == sorted(i for i, r in scores.items() if r.held_out) and len(out) > 200
    right = [scores[i].predicted == labels[i][2] for i in out]
    assert np.mean(right) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in scores.values())


def test_filter_keeps_what_scores_below(spark, fitted):
    docs, _, frame, model = fitted
    gone = {r.doc_id for r in toxicity.toxicity_scores(frame, model).collect() if r.predicted}
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - gone


def test_held_out_labels_do_not_matter(spark, fitted):
    docs, labels, frame, model = fitted
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, q, t, x in labels]
    again = toxicity.fit_toxicity(frame.repartition(3), spark.createDataFrame(
        flipped, "doc_id long, quality int, toxic int, text string"))
    assert (again["index"] == model["index"]).all() and (again["weight"] == model["weight"]).all()


def test_edges(spark, fitted):
    _, _, _, model = fitted
    rows = [(None, "scum moron scum trash", ""), (1, None, ""), (2, "", ""), (3, "x " * 50000, ""), (3, "x " * 50000, "")]
    found = toxicity.toxicity_scores(spark.createDataFrame(rows, ROWS), model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    scores = {(r.doc_id, r.held_out): r.score for r in found}
    assert scores[1, zlib.crc32(b"1") % 3 == 1] == scores[2, zlib.crc32(b"2") % 3 == 1]
    assert toxicity.toxicity_scores(spark.createDataFrame([], ROWS), model).collect() == []
    nothing = toxicity.fit_toxicity(spark.createDataFrame(rows, ROWS), spark.createDataFrame(
        [(None, 1), (3, None), (3, 7)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.toxicity_scores(spark.createDataFrame(rows, ROWS), nothing).collect()} == {0.5}


def test_features_by_hand():
    one, counts = toxicity.coordinates([b"a B c, d", b"", b"a b"])
    # words, then pairs with none, one and two words between
    assert counts.tolist() == [4 + 3 + 2 + 1, 0, 2 + 1]
    assert set(one[10:].tolist()) <= set(one[:10].tolist())


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in rows.select("doc_id", held_out().alias("out")).collect():
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_training_equals_a_plain_loop():
    """The update rule written out coordinate by coordinate, with nothing shared but the settings."""
    pick = random.Random(4)
    rows = [np.array(sorted(pick.sample(range(40), pick.choice([0, 3, 12]))), np.int32) for _ in range(200)]
    labels = np.array([float(sum(r % 7 == 0) > pick.random()) for r in rows])
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for row, label in zip(rows, labels):
            w = {i: weight(i) for i in [*row.tolist(), "constant"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, wi in w.items():
                rate_change = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate_change * wi
                n[i] = n.get(i, 0.0) + g * g
    want = {(1 << toxicity.DIMENSION_BITS) if i == "constant" else i: weight(i) for i in z if weight(i)}
    model = toxicity.fit_ftrl(rows, labels)
    found = dict(zip(model["index"].tolist(), model["weight"].tolist()))
    assert 5 < len(want) and found.keys() == want.keys()
    assert all(found[i] == pytest.approx(w, rel=1e-9) for i, w in want.items())


def test_scores_equal_a_plain_sum(spark, fitted):
    """Words, pairs and skip pairs of each text, looked up one by one in the model."""
    docs, _, frame, model = fitted
    weights = dict(zip(model["index"].tolist(), model["weight"].tolist()))
    found = {r.doc_id: r for r in toxicity.toxicity_scores(frame, model).collect()}
    for i, text, _ in docs[:150]:
        features = set()
        for start in range(len(text.split())):
            for gap in (0, 1, 2, 3):
                features |= set(toxicity.coordinates([" ".join(text.split()[start:start + gap + 1]).encode()])[0].tolist())
        margin = weights.get(1 << toxicity.DIMENSION_BITS, 0.0) + sum(weights.get(f, 0.0) for f in features)
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)
        assert found[i].predicted == int(found[i].score >= 0.7)
