"""The stages, each against brute force on what its predecessor kept."""

import random

import pytest
import test_decontaminate
import test_simhash
import test_substrings

import __spark_entry__
import corpus_pipeline
from packhouse.llm.decontaminate import plain_words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    pick = random.Random(11)
    words = [f"word{i}" for i in range(800)]
    items = [(i, " ".join(pick.choices(words, k=pick.choice([15, 40])))) for i in range(12)]
    passages = [pick.choices(words, k=pick.choice([30, 70])) for _ in range(6)]
    docs, labels = [], []
    for i in range(260):
        text = pick.choices(words, k=pick.choice([40, 150, 400]))
        kind = pick.random()
        if kind < 0.2:
            text[5:5] = pick.choice(passages)
        elif kind < 0.35:
            text[9:9] = pick.choice(items)[1].split()
        elif kind < 0.5 and docs:
            text = pick.choice(docs)[1].split()
        toxic = int(pick.random() < 0.25)
        for _ in range(4 * toxic):
            text.insert(pick.randrange(len(text) + 1), pick.choice(["scum", "moron"]))
        docs.append((i, pick.choice([" ", "\n"]).join(text), "en", "s"))
        labels.append((i, 1, toxic))
    docs += [(900, None, None, None), (901, "", "en", "s"), (902, " ", "en", "s"), (903, "short", "en", "s"), (903, "short", "en", "s"),
             (None, "no id at all", None, "s")]
    return [(*d, len(d[1] or "")) for d in docs], labels, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = corpus()
    spark.createDataFrame(docs, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{folder}/out{i}")
        kept.append(spark.read.parquet(f"{folder}/out{i}"))
    return folder, [[r.asDict() for r in k.collect()] for k in kept], [k.columns for k in kept], dict((i, t) for i, _, t in labels), items


def test_columns(stages):
    _, _, columns, _, _ = stages
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert columns[:5] == [names] * 5 and columns[5] == [*names, "ids", "n_tokens"]


def test_toxic_documents_go(stages):
    _, kept, _, toxic, _ = stages
    before, after = ({r["doc_id"] for r in k} for k in kept[:2])
    assert all(toxic.get(i) for i in before - after)
    assert len(before - after) > 0.6 * sum(toxic.values())


def test_one_of_each_group_stays(stages):
    _, kept, _, _, _ = stages
    rows = sorted((r for r in kept[1] if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    labels = test_simhash.brute_components([test_simhash.brute_fingerprint(r["text"]) for r in rows], 2)
    expected = {rows[label]["doc_id"] for label in labels}
    found = [r["doc_id"] for r in kept[2] if r["doc_id"] is not None]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) < len(rows) - 10
    assert sum(r["doc_id"] is None for r in kept[2]) == 1


def test_repeated_passages_go(stages):
    _, kept, _, _, _ = stages
    rows = {r["doc_id"]: r for r in kept[2]}
    expected = test_substrings.brute([(i, r["text"]) for i, r in rows.items()], 20)
    expected[None] = 0, 0, None
    found = {r["doc_id"]: r for r in kept[3]}
    assert set(found) == {i for i, (n, gone, _) in expected.items() if not n or gone < n}
    assert sum(gone > 0 for _, gone, _ in expected.values()) > 5
    for i, r in found.items():
        text = expected[i][2] if expected[i][1] else rows[i]["text"]
        assert r == {**rows[i], "text": text, "n_chars": len(text) if expected[i][1] else rows[i]["n_chars"]}


def test_contaminated_documents_go(stages):
    _, kept, _, _, items = stages
    found = {d for d, _ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in kept[3]], items)}
    assert {r["doc_id"] for r in kept[4]} == {r["doc_id"] for r in kept[3]} - found and len(found) > 5
    assert plain_words(b"A, b") == [b"a", b"b"]


def test_ids_stand_for_the_texts(stages):
    _, kept, _, _, _ = stages
    before = {r["doc_id"]: r for r in kept[4]}
    assert len(kept[5]) == len(before)
    for r in kept[5]:
        assert {k: v for k, v in r.items() if k in before[r["doc_id"]]} == before[r["doc_id"]]
        assert r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] > 0) == bool(r["text"])


def test_run_is_all_stages(spark, stages):
    folder, kept, _, _, _ = stages
    found = __spark_entry__.queries()["pipeline"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(r["doc_id"]), r["n_tokens"]) for r in kept[5])


def test_empty_documents(spark, stages):
    folder = stages[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_an_own_column_decoded_stays(spark):
    docs = spark.createDataFrame([(1, "some text", "own", "more")], "doc_id long, text string, decoded string, _Decoded string")
    (row,) = corpus_pipeline.encoded(spark, docs, "").collect()
    assert (row.text, row.decoded, row._Decoded, row.n_tokens) == ("some text", "own", "more", len(row.ids))
