import random

import numpy as np
import pytest

from packhouse.llm.decontaminate import (MultiIndex, bag, contaminations, plain_words, similarity, without_contaminated)

DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string"


def brute(docs, items, least=0.8):
    """Every window of an item's size, without fingerprints."""
    out = {}
    for d, text, *_ in docs:
        words = plain_words((text or "").encode())
        for i, item in items:
            own = plain_words((item or "").encode())
            size, shingle = min(len(own), len(words)), min(5, len(own))
            if not own or size < shingle:
                continue
            goal = bag(own, shingle)
            best = max((similarity(bag(words[s:s + size], shingle), goal), -s) for s in range(len(words) - size + 1))
            if best[0] >= least:
                out[d, i] = best[0], -best[1], size
    return out


def corpus():
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(pick.choices(vocabulary, k=pick.choice([3, 15, 30, 59])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "w1 w2"), (93, items[4][1]), (94, " ".join(["w7", "w8"] * 20))]
    docs = [(0, None, "en"), (1, "", "en"), (2, "w1, W2!", "en"), (3, "w1", None), (4, "w7 w8 " * 200, "en")]
    for d in range(5, 80):
        words = pick.choices(vocabulary, k=pick.choice([10, 200, 600]))
        if pick.random() < 0.6:
            own = plain_words(pick.choice(items[:25])[1].encode())
            own = [w.decode() for w in own]
            for _ in range(pick.choice([0, 0, 1, 2, 5])):
                own[pick.randrange(len(own))] = pick.choice(vocabulary)
            cut = pick.choice([0, 0, 1, 3])
            at = pick.randrange(len(words))
            words[at:at] = [w.title() + pick.choice(["", ",", "."]) for w in own[cut:]]
        docs.append((d, pick.choice([" ", "\n"]).join(words), "en"))
    return docs, items


@pytest.mark.parametrize("block", [5000, 7])
def test_equals_all_windows(spark, block):
    docs, items = corpus()
    expected = brute(docs, items)
    found = contaminations(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), items=block).collect()
    assert len(found) == len(expected) > 15
    for r in found:
        similar, start, size = expected[r.doc_id, r.item_id]
        assert (r.similarity, r.start, r.n_words) == (pytest.approx(similar), start, size)
        assert 0 <= r.distance <= 20
    kept = without_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), items=block)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in expected}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 60, np.uint64)
    queries = np.repeat(prints, 8)
    for i in range(len(queries)):
        for b in rng.permutation(64)[:i % 26]:
            queries[i] ^= np.uint64(1) << np.uint64(b)
    found = set(zip(*(x.tolist() for x in MultiIndex(prints, 20)(queries))))
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= 20
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_empty_tables_and_other_columns(spark):
    no_items, no_docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([], DOCS)
    docs = spark.createDataFrame([(1, "a b c d e f", 9, 9)], "doc_id long, text string, item_id int, start int")
    items = spark.createDataFrame([(1, "a b c d e f", "x")], "item_id long, text string, similarity string")
    assert contaminations(docs, no_items).collect() == [] and contaminations(no_docs, items).collect() == []
    assert [tuple(r) for r in contaminations(docs, items).collect()] == [(1, 1, 1.0, 0, 6, 0)]
    assert without_contaminated(docs, no_items).count() == 1 and without_contaminated(docs, items).count() == 0
    twice = docs.unionAll(docs).unionAll(docs.withColumn("doc_id", docs.doc_id * 0).replace(0, None, "doc_id"))
    assert contaminations(twice, items).count() == 3
