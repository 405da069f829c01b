"""Queries with SQL against DuckDB, and the digest columns of the others on a small table."""

import hashlib

import pytest
from compare import connect, differences

from packhouse.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op4_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op5_simhash_near_duplicates", ["doc_id", "fingerprint", "component_id"]),
    ("op10_main_content", ["page_id", "url", "text", "n_chars"]),
])
def test_one_row_per_row(spark, name, columns):
    found = queries.queries()[name](spark, FOLDER)
    source = "pages" if "page_id" in columns else "documents"
    assert found.columns == columns and found.count() == queries.table(spark, FOLDER, source).count()


def test_substring_digests(spark):
    from test_substrings import brute

    rows = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    expected = brute(rows, 20)
    for r in queries.op3_substring_dedup(spark, FOLDER).collect():
        n, gone, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_bpe_digests(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    found = queries.op7_byte_level_bpe(spark, FOLDER)
    assert sorted(found.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]
    for r in found.collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
