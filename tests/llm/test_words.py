import random

import numpy as np
import pyarrow as pa

from packhouse.llm.words import RangeHash, slices, word_names


def test_names_follow_the_words():
    pick = random.Random(2)
    texts = [b"", b" ", b"\n\n", b"a", b"  a b\x0b\x0cc ", "é\xa0è x".encode(), b"x" * 5000]
    texts += [b"".join(pick.choices([b"a", b"b", b" ", b"\t", b"\x1c", b"\x00"], k=pick.randrange(60))) for _ in range(400)]
    names, counts = word_names(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, names.tolist()))) == len(set(words)) == len(set(names.tolist()))
    assert word_names([])[1].tolist() == []


def test_ranges_hash_alike_wherever_they_are():
    names, _ = word_names([b"p q r x y p q r x q"])
    ranges = RangeHash(names)
    found = ranges(np.array([0, 5, 0]), np.array([4, 9, 3]))
    assert found[0] == found[1] != found[2]


def test_slices_are_whole_and_bounded():
    texts = ["x" * n for n in (0, 5, 100, 3, 3, 3)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"])
    parts = list(slices([batch, batch.slice(0, 0)], size=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(8))
    assert all(sum(len(x or "") for x in p.column(1).to_pylist()) <= 10 or p.num_rows == 1 for p in parts)
