import random

import numpy as np
import pytest

from packhouse.llm.substrings import Units, cut_repeats, representatives, without_repeats
from packhouse.llm.words import word_names

ROWS = "doc_id long, text string, n_words string"


def brute(rows, window):
    """doc_id -> (words, removed, kept), by the definition."""
    seen, out = set(), {}
    for d, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone[s:s + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[d] = len(words), sum(gone), b" ".join(kept).decode()
    return out


def corpus(seed, letters, n=90):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(letters)]
    passages = [pick.choices(vocabulary, k=pick.choice([5, 20, 25, 60, 150])) for _ in range(8)]
    rows = [(None, " ".join(passages[4])), (1000, None), (1001, ""), (1002, " \n\x0b"), (1003, "a " * 500), (1004, "a " * 70),
            (1005, "Is onhe. " * 60), (1006, "x Is onhe. " * 30), (1007, "é\xa0ß " * 19),
            (1008, " ".join(f"own{i % 30}" for i in range(75)))]
    for d in range(n):
        words = []
        for _ in range(pick.choice([1, 2, 5])):
            kind = pick.random()
            if kind < 0.4:
                words += pick.choice(passages)
            elif kind < 0.5:
                words += pick.choice(vocabulary[:2]).split() * pick.choice([3, 30, 45])
            else:
                words += pick.choices(vocabulary, k=pick.choice([0, 1, 12, 40, 200]))
        if rows and pick.random() < 0.3:
            words = (pick.choice(rows[1:])[1] or "").split(" ")
            if words and pick.random() < 0.7:
                words[pick.randrange(len(words))] = "changed"
        rows.append((d * 7 % 997, pick.choice([" ", "\n ", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize(("letters", "window"), [(3000, 20), (12, 20), (2, 20), (30, 3)])
def test_equals_the_definition(spark, letters, window):
    rows = corpus(letters, letters)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], ROWS).repartition(7)
    expected = brute(rows, window)
    answers = without_repeats(docs, window).collect()
    assert len(answers) == len(rows) and answers[0].__fields__ == ["doc_id", "text", "n_words", "n_removed", "kept"]
    for r in answers:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id], r.doc_id
    assert sum(e[1] > 0 for e in expected.values()) > 20


@pytest.mark.parametrize("letters", [2, 5, 1000])
def test_equal_windows_have_equal_representatives(letters):
    rng = np.random.default_rng(letters)
    words = [b"%d" % i for i in rng.integers(0, letters, 3000)]
    words[100:100] = words[700:760]
    words[2000:2000] = words[700:790]
    n = len(words)
    low, high = representatives(word_names([b" ".join(words)])[0], np.arange(n) <= n - 20, 20)
    seen, repeats = {}, 0
    for s in range(n - 19):
        assert s <= low[s] < high[s] <= s + 20
        key = tuple(words[s:s + 20])
        repeats += key in seen
        assert seen.setdefault(key, (low[s] - s, high[s] - s)) == (low[s] - s, high[s] - s)
    assert repeats > 50


def test_units_are_few():
    rng = np.random.default_rng(1)
    text = b" ".join(b"%d" % i for i in rng.integers(0, 5000, 20000))
    assert len(Units([text]).start) < 20000 / 6


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_with_names_of_our_own(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5, [1], 7)], "doc_id long, text string, _id int, _first array<int>, n_words int")
    (row,) = without_repeats(docs).collect()
    assert (row._id, row._first, row.n_words) == (5, [1], 30)
    (row,) = cut_repeats(docs).collect()
    assert (row._id, row._first, row.n_words) == (5, [1], 7)


def test_columns_with_names_used_on_the_way(spark):
    own = {"__id": 1, "__Repeated": 2, "__first": 3, "__mixed": 4, "__windows": 5, "_own_kept": 6, "__own0": 7, "Kept": 8}
    docs = spark.createDataFrame([(i, "a b c " * 10, *own.values()) for i in (1, 2)],
                                 "doc_id long, text string, " + ", ".join(f"{c} int" for c in own))
    without = [c for c in own if c != "Kept"]
    rows = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert all([r[c] for c in without] == [own[c] for c in without] for r in rows.values())
    assert [rows[i].n_removed for i in (1, 2)] == [27, 30] and rows[1].kept == "a b c"
    (row,) = cut_repeats(docs).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b c", **own}
