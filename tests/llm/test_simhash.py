import random

import pytest
import xxhash
from pyspark.sql import functions as F

from packhouse.llm.components import stars
from packhouse.llm.simhash import near_links, one_per_group, simhash_groups

ROWS = "doc_id long, text string"


def brute_fingerprint(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    parts = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def texts(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(60)]
    out = [None, "", " \n\t", "one", "One two", "a b a b", "ONE", "x " * 3000]
    while len(out) < n:
        base = [pick.choice(vocabulary) for _ in range(pick.choice([2, 30, 400, 900]))]
        for _ in range(pick.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(pick.choice([0, 1, 2])):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            out.append(pick.choice([" ", "\n", "\x0b  "]).join(copy))
    return out[:n]


@pytest.mark.parametrize("bucket", [512, 1])
def test_groups_equal_brute_force(spark, bucket):
    rows = [(i * 3, t) for i, t in enumerate(texts(1, 160))]
    found = {r.doc_id: r for r in simhash_groups(spark.createDataFrame(rows, ROWS), bucket=bucket).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    labels = brute_components(prints, 2)
    assert len(found) == len(rows)
    for (i, _), p, label in zip(rows, prints, labels):
        assert found[i].fingerprint == f"{p:016x}"
        assert found[i].component_id == rows[label][0]
    assert len(set(labels)) < len(rows) - 30


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("bucket", [512, 2])
def test_no_link_within_the_distance_is_lost(spark, distance, bucket):
    pick = random.Random(distance)
    prints = set()
    while len(prints) < 220:
        p = pick.getrandbits(64)
        for _ in range(pick.choice([1, 2, 6])):
            prints.add(p)
            for _ in range(pick.choice([1, 2, 3, 4])):
                p ^= 1 << pick.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, bucket).collect()
    for a, b in links:
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() or a == b
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    brute = brute_components(prints, distance)
    groups, theirs = {}, {}
    for p, g in zip(signed, brute):
        groups.setdefault(g, set()).add(p)
        theirs.setdefault(root(p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain_and_hub_contract(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = dict(tuple(r) for r in stars(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 71)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_missing_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "x y z", 1), (7, "x y z", 2), (7, "x y z", 2), (None, "q w e r t", 3)]
    found = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash_groups(spark.createDataFrame([], ROWS)).collect() == []


def test_one_row_of_each_group_with_all_its_columns(spark):
    rows = [(3, "x y z", 1), (7, "x  y z", 2), (3, "x y z", 1), (None, "q", 4), (8, "other words here", 5)]
    kept = one_per_group(spark.createDataFrame(rows, "doc_id long, text string, _id int"))
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted((r.doc_id or 0, r._id) for r in kept.collect()) == [(0, 4), (3, 1), (8, 5)]


def test_each_group_keeps_one_row_whatever_the_ids(spark):
    near, other, third = "a b c d e f", "quite another text than that", "and one more of its own kind"
    rows = [(3, near, 1), (5, near, 2), (5, other, 3), (None, near, 4), (None, third, 5), (None, third, 6), (None, "alone here now", 7),
            (9, None, 8), (9, "", 9), (3, third.upper() + " x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for some in (docs, docs.repartition(7, "row"), docs.orderBy(F.desc("row"))):
        kept = sorted(r.row for r in one_per_group(some).collect())
        assert {1, 3, 7, 10} <= set(kept) and len(kept) == 6
        assert len({5, 6} & set(kept)) == len({8, 9} & set(kept)) == 1
