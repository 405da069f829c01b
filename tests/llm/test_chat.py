"""Formatted conversations against a plain rendering, and read back against the rows they came from."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest

from packhouse.llm import chat, queries
from packhouse.llm.queries import public_vocabulary

pytest.importorskip("public_tokenizers")
SCHEMA = "conv_id long, turn long, role string, text string, ids int"


def rows():
    pick = random.Random(5)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "[", "<", "é", "ok ", "[\\INST]", "<\\\\/s>", "漢", " x", "\n"]
    found = [(-1, 0, "user", queries.MARKED, 1), (-1, 1, "assistant", queries.MARKED, 1), (None, 2, None, None, 1),
             (None, None, "assistant", "first", 1), (7, 0, "assistant", "", 1), (7, 0, "assistant", "", 1),
             (8, 3, "[INST]", "odd role", 1), (9, 0, "assistant", "long " * 30_000, 1)]
    for c in range(10, 60):
        for t in range(pick.randrange(1, 6)):
            found.append((c, t // 2, pick.choice(["user", "assistant", "system"]), "".join(pick.choices(bits, k=pick.randrange(12))), 1))
    return found


def grouped():
    turns = defaultdict(list)
    for c, t, r, x, _ in rows():
        turns[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}


@pytest.mark.parametrize("piece_bytes", [chat.PIECE_BYTES, 40])
def test_round_trip_whole_and_in_pieces(spark, piece_bytes):
    ranks, pattern = public_vocabulary()
    formatted = chat.format_chats(spark.createDataFrame(rows(), SCHEMA), ranks, pattern, piece_bytes=piece_bytes).persist()
    read = chat.read_chats(formatted, ranks).persist()
    back, learned, rendered = defaultdict(list), defaultdict(str), defaultdict(str)
    for r in sorted(read.collect(), key=lambda r: (r.conv_id or 0, r.piece)):
        back[r.conv_id] += [(t.role, t.text) for t in r.turns]
        learned[r.conv_id] += r.learned
        rendered[r.conv_id] += r.rendered
        assert 0 <= r.piece < r.pieces
    expected = grouped()
    assert dict(back) == expected
    escape, t = chat.Template().escaper(), chat.Template()
    for c, turns in expected.items():
        assert learned[c] == "".join(x for r, x in turns if r == "assistant")
        assert rendered[c] == t.begin + "".join(t.turn + escape(r) + t.text + escape(x) + t.end for r, x in turns)
    pieces = formatted.count()
    assert pieces == len(expected) if piece_bytes > 1000 else pieces > len(expected)
    for r in chat.chat_digests(read).collect():
        said = "".join(f"{role}\n{text}\n" for role, text in expected[r.conv_id])
        assert (r.n_turns, r.turns_sha256) == (len(expected[r.conv_id]), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (
            len(learned[r.conv_id]), hashlib.sha256(learned[r.conv_id].encode()).hexdigest())
        assert r.formatted_chars == len(rendered[r.conv_id])


def test_texts_make_no_reserved_ids_and_the_mask_covers_only_learned_texts(spark):
    ranks, pattern = public_vocabulary()
    first = chat.reserved_ids(ranks)
    turns = grouped()
    for r in chat.format_chats(spark.createDataFrame(rows(), SCHEMA), ranks, pattern).collect():
        n = len(turns[r.conv_id])
        assert [sum(i == first + k for i in r.ids) for k in range(4)] == [1, n, n, n] and max(r.ids) < first + 4
        assert len(r.ids) == len(r.loss_mask) and not any(m and i >= first for i, m in zip(r.ids, r.loss_mask))


def test_escaping_every_short_string_returns():
    template = chat.Template("<s>", "[A]", "[B]", "</s>")
    escape, unescape = template.escaper(), template.unescaper()
    seen = {}
    for n in range(6):
        for letters in itertools.product("[A]\\", repeat=n):
            text = "".join(letters)
            out = escape(text)
            assert unescape(out) == text and "[A]" not in out and seen.setdefault(out, text) == text


def test_control_strings_that_overlap_are_refused():
    for marks in (("<s>", "<s>", "[/I]", "</s>"), ("<s>", "<s>x", "[/I]", "</s>"), ("<", "[I]", "[/I]", "</s>"),
                  ("<<s>", "[I]", "[/I]", "</s>"), ("<\\s>", "[I]", "[/I]", "</s>")):
        with pytest.raises(ValueError):
            chat.Template(*marks)


def test_empty_table(spark):
    ranks, pattern = public_vocabulary()
    formatted = chat.format_chats(spark.createDataFrame([], SCHEMA), ranks, pattern)
    assert formatted.collect() == [] and chat.chat_digests(chat.read_chats(formatted, ranks)).collect() == []
