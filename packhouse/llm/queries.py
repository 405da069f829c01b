"""The registered queries opN_<name> and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.llm import (
    align, bpe, bursttrie, chat, decontaminate, imatch, language, maincontent, rollups, simhash, substrings, toxicity, warc)
from packhouse.llm.ship import shipped
from packhouse.sources.shared import materialize, new_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit_language(docs))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", substrings.kept_digest().alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, table(spark, folder, "labels")))


def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), shingle=3, distance=2)


def op6_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


def op7_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, pattern).drop("text"), ranks)
    return bpe.id_digests(coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Ranks and pattern of an installed public vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op8_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_pages(table(spark, folder, "pages"), least=0)
    return records.select(*warc.digest_columns(records))


def op9_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four batches over all documents, three of them applied twice: all are counted by words; copies of an
    earlier text go; the two are made one snapshot; toxic ones go; those not in English are counted anew by pieces."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    # Both versions are counted in one pass over the texts; from here on only counts travel.
    counts = materialize(docs.select(
        "doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        rollups.count_tokens(F.col("text"), "words-1").alias("words"),
        F.when(F.col("lang") != "en", rollups.count_tokens(F.col("text"), "pieces-1")).alias("pieces")), "counts")
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id").distinct()
    singles = counts.join(first, "doc_id", "left_semi")
    left = singles.join(toxic, "doc_id", "left_anti").filter("lang <> 'en'")

    def by(rows: DataFrame, version: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(version.split("-")[0]).alias("tokens"))

    totals = rollups.TokenRollup(spark, new_folder(spark, "rollup"))
    totals.apply("load", rollups.inserts(by(counts, "words-1")))
    totals.apply("copies", rollups.deletes(by(counts.join(first, "doc_id", "left_anti"), "words-1")))
    totals.compact()
    totals.clean()
    totals.apply("load", rollups.inserts(by(counts, "words-1")))
    totals.apply("copies", rollups.deletes(by(counts.join(first, "doc_id", "left_anti"), "words-1")))
    totals.apply("toxic", rollups.deletes(by(singles.join(toxic, "doc_id", "left_semi"), "words-1")))
    for _ in range(2):
        totals.apply("pieces", rollups.revisions(by(left, "words-1"), by(left, "pieces-1")))
    return totals.totals()


OP9_SQL = r"""
with ranked as (
  select doc_id, text, source, lang, min(doc_id) over (partition by text) as first_id from documents),
kept as (
  select source, lang, text, case when lang <> 'en' then 'pieces-1' else 'words-1' end as tokenizer from ranked
  where doc_id = first_id and doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null))
select source, lang, tokenizer, count(*) as n_docs, cast(sum(
  case when tokenizer = 'words-1' then len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  else len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+')) end) as bigint) as n_tokens
from kept group by source, lang, tokenizer
"""

OP8_SQL = r"""
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload, max(page_id) over (partition by coalesce(html, '')) as largest from pages),
bits as (
  select page_id, largest, octet_length(payload) as payload_bytes, sha1(payload) as digest from payloads)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (cast('0x' || substr(digest, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1)),
    lambda x, y: x || y) as payload_digest,
  case when largest > page_id then 'revisit' else 'response' end as record_type,
  case when largest > page_id then largest end as refers_to
from bits
"""


def op10_main_content(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return maincontent.extract(pages, maincontent.fit_blocks(pages))


#: A conversation whose texts look like marks of the template.
MARKED = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, which are written as a table of ids and masks."""
    ranks, pattern = public_vocabulary()
    marked = spark.createDataFrame(
        [(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    formatted = materialize(chat.format_chats(rows, ranks, pattern), "chats")
    return chat.chat_digests(chat.read_chats(formatted, ranks))


def rebuilt(own: DataFrame) -> DataFrame:
    """Sequences (conv_id, ids, chars) whose first h turns are those of the conversation that begins their hundred."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    firsts = own.filter("conv_id % 100 = 0").select(
        F.col("conv_id").alias("hundred"), F.slice("ids", 1, 10).alias("first_ids"), F.slice("chars", 1, 5).alias("first_chars"))
    joined = own.join(firsts, F.col("conv_id") - F.col("conv_id") % 100 == F.col("hundred"), "left")

    def mixed(first: str, rest: str, width: int) -> F.Column:
        taken = F.coalesce(F.slice(first, F.lit(1), h * width), F.slice(rest, 1, 0))
        return F.concat(taken, F.slice(rest, h * width + 1, F.size(rest))).alias(rest)

    return joined.select("conv_id", mixed("first_ids", "ids", 2), mixed("first_chars", "chars", 1))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = materialize(bursttrie.sequences(table(spark, folder, "conversations")), "sequences")
    return bursttrie.prefix_trie(materialize(rebuilt(own), "rebuilt"))


OP12_SQL = r"""
with own as (
  select conv_id, list(struct_pack(id := sha256(coalesce(role, '')) || sha256(coalesce(text, '')),
                                   chars := length(coalesce(text, '')))
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
cut as (
  select conv_id, turns, (4294967295 - list_reduce(range(0, 8 * length(cast(conv_id as varchar))),
    lambda a, k: case when (xor(a, case when k % 8 = 0 then ascii(substr(cast(conv_id as varchar), 1 + k // 8, 1)) else 0 end) & 1) = 1
      then xor(xor(a, case when k % 8 = 0 then ascii(substr(cast(conv_id as varchar), 1 + k // 8, 1)) else 0 end) >> 1, 3988292384)
      else xor(a, case when k % 8 = 0 then ascii(substr(cast(conv_id as varchar), 1 + k // 8, 1)) else 0 end) >> 1 end,
    4294967295)) % 6 as h
  from own),
convs as (
  select c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) as turns
  from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
passed as (
  select conv_id, d, len(turns) as length, case when d = 0 then 0 else turns[d].chars end as chars,
    sha256(array_to_string(list_transform(list_slice(turns, 1, d), lambda t: t.id), ',')) as node,
    case when d > 0 then sha256(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda t: t.id), ',')) end as parent
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from convs)),
nodes as (
  select node, any_value(parent) as parent, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs,
    any_value(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where length = d), '')) as ends_sha256
  from passed group by node),
children as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
sums as (
  select p.node, count(*) filter (where c.n_children is null) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
  from nodes n left join children c on c.parent = n.node join passed p on p.conv_id = n.conv_id and p.d <= n.depth
  group by p.node)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) as n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join sums s on s.node = n.node left join nodes u on u.node = n.parent left join children c on c.parent = n.node
"""


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Texts are tokenised once; groups are kept as digests, and linked pairs wait in a table until all are counted."""
    import public_tokenizers

    sides = [(kind, bpe.read_ranks(public_tokenizers.path(file))) for kind, file in (
        ("byte_level", "byte_bpe_50k.json"), ("pieces", "piece_bpe_32k.model"))]
    docs = table(spark, folder, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = materialize(align.align(docs, *sides).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "pair_links"), "aligned")
    counts = align.link_counts(aligned, align.vocabulary_size(sides[1]))
    return align.with_counts(aligned, counts).drop("pairs", "pair_links")


def queries() -> dict[str, Query]:
    return {f.__name__: shipped(f) for f in (
        op1_benchmark_decontamination, op2_language_id, op3_substring_dedup, op4_toxicity, op5_simhash_near_duplicates,
        op6_imatch_fingerprints, op7_byte_level_bpe, op8_warc_archives, op9_token_rollups, op10_main_content,
        op11_chat_formatting, op12_conversation_trie, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_archives": OP8_SQL, "op9_token_rollups": OP9_SQL, "op12_conversation_trie": OP12_SQL}
