import hashlib
import random
import re
import string
import struct
from collections import Counter

import pytest
import xxhash

from packhouse.llm import imatch

ROWS = "doc_id long, text string"


def number(term):
    return xxhash.xxh64_intdigest(term.encode(), 42) & imatch.LOW


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def level_hash(t, level):
    seed = chained([t]) & (1 << 64) - 1
    out = xxhash.xxh64_intdigest(struct.pack("<i", level), seed)
    return out - (1 << 64) if out >> 63 else out


def terms(text):
    return {number(w) for w in re.split(rf"[ \t\n\x0b\f\r{re.escape(string.punctuation)}]+", (text or "").lower()) if w}


def hashes(text, words):
    out = []
    for level in range(imatch.RATES):
        parts = {t: level_hash(t, level) % (imatch.SUBSETS * 4**level) for t in (terms(text) & words) or terms(text)}
        for s in range(imatch.SUBSETS):
            own = sorted((s << 32) | t for t, p in parts.items() if p == s)
            out.append(chained(own) % 65535 + 1 if own else 0)
    return out


def alike(a, b):
    if a == b:
        return 1.0
    out = 0.0
    for level in range(imatch.RATES):
        pairs = [p for p in list(zip(a, b))[level * imatch.SUBSETS:(level + 1) * imatch.SUBSETS] if any(p)]
        if len(pairs) >= (imatch.ENOUGH if level else 1):
            out = sum(x == y for x, y in pairs) / len(pairs)
    return out


def corpus():
    pick = random.Random(8)
    vocabulary = [f"t{i}é" for i in range(300)]
    rows = [(5000, None), (4000, ""), (3, "x"), (4, "Solo, solo!"), (4, "two rows"), (4, "two rows"), (None, "none at all"), (None, None)]
    for i in range(60):
        rows.append((100 + 7 * i, pick.choice([" ", "\n", ", "]).join(pick.choices(vocabulary, k=pick.choice([3, 40, 400])))))
    return rows + [(9000, rows[20][1]), (9001, "t1é " * 4000)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, ROWS).repartition(5)
    counts = Counter(t for _, text in rows for t in terms(text))
    words = {t for t, n in counts.items() if max(2, .005 * len(rows)) <= n <= max(2, .2 * len(rows))}
    assert set(imatch.lexicon(docs)) == words and len(words) > 20

    def mark(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    places = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1])))
    expected = Counter()
    for i, text in rows:
        at = places.index((i, text or ""))
        own, following = places[at][1], places[(at + 1) % len(places)][1]
        third = len(own) // 3
        other = own[:len(own) - third] + following[:third]
        a, b, c = (hashes(t, words) for t in (own, other, following))
        expected[i, len(own), hashlib.sha256(other.encode()).hexdigest(), "".join(f"{x:04x}" for x in a),
                 "".join(f"{x:04x}" for x in b), alike(a, b), alike(a, c)] += 1
    assert Counter(tuple(r) for r in imatch.fingerprints(docs).collect()) == expected


def test_no_python_in_the_plan(spark):
    plan = imatch.fingerprints(spark.createDataFrame(corpus(), ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the world")], [(1, None), (2, None)]])
def test_small_tables(spark, rows):
    found = imatch.fingerprints(spark.createDataFrame(rows, ROWS)).collect()
    assert len(found) == len(rows)
    assert all(r.near_next == 1.0 and len(r.fingerprint) == 384 for r in found)


def test_texts_without_common_words_differ(spark):
    rows = [(1, "quite alone"), (2, "never seen"), (3, "quite alone"), (4, "...")]
    found = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, ROWS)).collect()}
    assert found[1].fingerprint == found[3].fingerprint != found[2].fingerprint
    assert found[3].near_next == 0.0 and set(found[4].fingerprint) == {"0"}
