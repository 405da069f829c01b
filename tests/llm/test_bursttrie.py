"""Burst tries against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences

from packhouse.llm import bursttrie, queries

SCHEMA = "conv_id long, turn long, role string, text string, ids string, key_1 int"


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def as_rows(found):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in found.collect())


def conversations():
    """Copies, a long shared beginning, prefixes of one another, null and empty parts, ids across blocks."""
    pick = random.Random(6)
    convs = {}
    for c in range(60):
        convs[c] = [pick.choice([("user", "a"), ("user", "bb"), ("assistant", "é漢")]) for _ in range(pick.randrange(1, 7))]
    long = [("user", f"turn {i}") for i in range(30)]
    for c in range(60, 90):
        convs[c] = long[:pick.choice([20, 29, 30])] + [("assistant", str(c % 7))] * (c % 3)
    for c in range(100_000, 100_000 + 3 * 70_000, 7000):
        convs[c] = [("user", "the same"), ("", "")]
    return convs


def frame(spark, convs):
    rows = [(c, t if t else None, r or None, x or None, "x", 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame([*rows, (None, 1, "user", "nobody's", "x", 1)], SCHEMA)


@pytest.mark.parametrize("limits", [(5000, 200_000), (4, 200_000), (5000, 40), (1, 1)])
def test_equals_the_dictionary_whatever_bursts(spark, limits):
    convs = conversations()
    own = bursttrie.sequences(frame(spark, convs)).persist()
    assert as_rows(bursttrie.prefix_trie(own, *limits)) == brute(convs)


def test_turnless_and_single_conversations(spark):
    schema = "conv_id long, ids array<long>, chars array<int>"
    none = spark.createDataFrame([(5, [], []), (3, [], [])], schema)
    nothing = hashlib.sha256(b"3,5").hexdigest()
    assert as_rows(bursttrie.prefix_trie(none)) == [(3, 0, -1, 2, 0, 1, 0, nothing)]
    one = as_rows(bursttrie.prefix_trie(spark.createDataFrame([(5, [1, 2], [4])], schema)))
    assert [r[:7] for r in one] == [(5, 0, -1, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
    assert bursttrie.prefix_trie(spark.createDataFrame([], schema)).collect() == []


def test_rows_without_order_or_with_the_same_turn_do_not_fail(spark):
    rows = [(1, None, "user", "a", "x", 1), (1, 2, "user", "b", "x", 1), (1, 2, "user", "c", "x", 1), (1, 2, "user", "c", "x", 1)]
    found = bursttrie.prefix_trie(bursttrie.sequences(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(r.depth for r in found.collect()) == [0, 1, 2, 3, 4]


def test_rebuilt_conversations(spark):
    """The query's input against a loop, with an absent first conversation of a hundred and a short one."""
    pick = random.Random(8)
    ids = [0, *pick.sample(range(1, 100), 30), *pick.sample(range(101, 200), 20), 300, 305, 307]
    convs = {c: [("user", f"{c} {t}") for t in range(pick.randrange(1, 9))] for c in ids}
    convs[300] = convs[300][:1]
    expected = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        expected[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    found = bursttrie.prefix_trie(queries.rebuilt(bursttrie.sequences(frame(spark, convs)).persist()), 3, 1000)
    assert as_rows(found) == brute(expected)


def test_query_equals_sql_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(queries.op12_conversation_trie(spark, folder), connect(folder), queries.OP12_SQL) == ""
