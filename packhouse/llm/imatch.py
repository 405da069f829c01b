"""I-Match fingerprints of texts, in DataFrame functions only.

The terms of a text are its distinct words in lower case, cut at white space and ASCII punctuation, each known by a hash of
`TERM_BITS` bits. Rare words that share a number with others add (mean number of terms of a text) / 2^TERM_BITS to its
frequency, far below the band at any number of documents. The lexicon has the terms whose inverse document frequency lies in a band, that is, which are in at least `RARE` and at
most `COMMON` of all documents. Randomised subsets of the lexicon are drawn at several rates: at each rate the terms are
dealt by a hash into `SUBSETS` * 4^rate parts, and the first `SUBSETS` parts are the subsets. The fingerprint has one hash for
each subset, of the sorted terms that the text has of it; 0 where it has none. A text without any term of the lexicon is
fingerprinted by all its terms instead, so that only texts without words have an empty fingerprint.

Likeness of two fingerprints: at the finest rate at which enough subsets are not empty in both, the share of these that agree.
Equal fingerprints have likeness 1; an empty one has likeness 0 to all others.

The lexicon is the only thing sent to all tasks, as a bitmap of 2^TERM_BITS bits; it has at most (mean number of terms of a
text) / RARE entries, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.operators.numbering import number_rows
from packhouse.sources.shared import materialize

RARE, COMMON = 0.005, 0.2
SUBSETS, RATES = 24, 4
#: Subsets that should not be empty for a rate to be used.
ENOUGH = 8
TERM_BITS = 22
LOW = (1 << TERM_BITS) - 1
#: xxhash64 of an empty array.
NO_TERMS = 42


def terms(text: Column) -> Column:
    """Distinct terms of a text as numbers below 2^TERM_BITS; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(LOW))))


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> list[int]:
    """Terms in at least `rare` (and two) and at most `common` of the rows of `texts` (text), over all of them.

    Terms are counted in each task before they are shuffled, as numbers.
    """
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.filter((F.col("df") >= max(2, rare * n)) & (F.col("df") <= max(2, common * n)))
    return sorted(r.term for r in band.select("term").collect())


def in_lexicon(found: Column, words: list[int]) -> Column:
    """The terms that the lexicon has. The bitmap is one constant of the plan, however many words there are."""
    bits = [0] * (1 << TERM_BITS - 6)
    for t in words:
        bits[t >> 6] |= 1 << (t & 63)
    signed = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in bits)
    bitmap = F.split(F.lit(signed), ",").cast("array<bigint>")
    return F.filter(found, lambda t: F.getbit(F.element_at(bitmap, (F.shiftright(t, 6) + 1).cast("int")),
                                              t.bitwiseAND(F.lit(63)).cast("int")) == 1)


def dealt(known: Column) -> list[Column]:
    """For each rate, a text's terms of the lexicon that are in a subset, with the subset in the high half, sorted."""
    def rate(level: int) -> Column:
        parts = F.lit(SUBSETS * 4**level)
        placed = F.transform(known, lambda t: F.shiftleft(F.pmod(F.xxhash64(t, F.lit(level)), parts), 32).bitwiseOR(t))
        return F.array_sort(F.filter(placed, lambda x: x < F.lit(SUBSETS << 32)))

    return [rate(level) for level in range(RATES)]


def subset_hashes(rates: list[Column]) -> Column:
    """The hashes of all subsets, 16 bits each, rate after rate, from columns that hold what `dealt` gives.

    The columns are named more than once on purpose: so Spark keeps them as computed and does not put their expressions
    into the loop over subsets.
    """
    def rate(own: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)),
                           lambda s: F.xxhash64(F.filter(own, lambda x: F.shiftright(x, 32) == s)))
        return F.when(F.size(own) == 0, F.array_repeat(F.lit(0), SUBSETS)).otherwise(F.transform(
            each, lambda h: F.when(h == NO_TERMS, F.lit(0)).otherwise(F.pmod(h, F.lit(65535)).cast("int") + 1)))

    return F.flatten(F.array(*[rate(own) for own in rates]))


def with_hashes(df: DataFrame, known: str, words: list[int]) -> DataFrame:
    """`df` with the terms in column `known` replaced by the subset hashes."""
    rates = [f"_rate{i}" for i in range(RATES)]
    df = df.withColumn("_kept", in_lexicon(F.col(known), words)).withColumn(
        known, F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col(known))).drop("_kept")
    return df.withColumns(dict(zip(rates, dealt(F.col(known))))).withColumn(
        known, subset_hashes([F.col(c) for c in rates])).drop(*rates)


def fingerprint(hashes: Column) -> Column:
    """Subset hashes as one string, four hex digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 4, "0")), ""))


def likeness(a: Column, b: Column, none: Column | None = None) -> Column:
    """0 to 1, from two arrays of subset hashes, in which `none` (0 by default) stands for a subset without terms."""
    none = F.lit(0) if none is None else none

    def at(level: int) -> tuple[Column, Column]:
        pairs = F.filter(F.arrays_zip(F.slice(a, SUBSETS * level + 1, SUBSETS).alias("a"),
                                      F.slice(b, SUBSETS * level + 1, SUBSETS).alias("b")),
                         lambda p: (p["a"] != none) | (p["b"] != none))
        return F.size(pairs), F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))

    out = F.lit(0.0)
    for level in range(RATES):
        some, equal = at(level)
        # A finer rate replaces a coarser one if it has enough to say.
        out = F.when(some >= (ENOUGH if level else 1), equal / some).otherwise(out)
    return F.when(a == b, F.lit(1.0)).otherwise(out)


def edited(text: Column, following: Column) -> Column:
    """The last third of a text (rounded down, in code points) replaced by as many from the start of the next one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. The next document is the one with the next smaller doc_id, after the last the first; rows
    without doc_id come last, rows that share one are ordered by a hash of the text, and equal rows count as one place and are all
    returned. A single document is its own next. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = lexicon(docs, rare, common)
    docs = docs.withColumn("mark", F.xxhash64("text"))
    places = number_rows(docs.select("doc_id", "mark", F.length("text").alias("n")).distinct(),
                         [F.desc_nulls_last("doc_id"), "mark"], "place")
    last = places.count()
    follows = places.withColumn("place", F.when(F.col("place") == 1, last).otherwise(F.col("place") - 1)).select(
        "place", F.col("doc_id").alias("next_id"), F.col("mark").alias("next_mark"))
    links = materialize(places.join(follows, "place").drop("place"), "links")
    # How much the document before takes from the start of this one; only that travels.
    takes = links.select(F.col("next_id").alias("_id"), F.col("next_mark").alias("_mark"), F.col("doc_id").alias("to_id"),
                         F.col("mark").alias("to_mark"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    heads = docs.join(takes, _same("doc_id", "_id") & (F.col("mark") == F.col("_mark"))).select(
        "to_id", "to_mark", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"))
    heads = heads.dropDuplicates(["to_id", "to_mark"])
    joined = docs.join(heads, _same("doc_id", "to_id") & (F.col("mark") == F.col("to_mark")))
    # Each step is used more than once by the next, and is computed once.
    answers = joined.select("doc_id", "mark", F.length("text").cast("long").alias("n_chars"), "text",
                            edited(F.col("text"), F.col("head")).alias("edited"))
    answers = answers.select(
        "doc_id", "mark", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"))
    answers = with_hashes(with_hashes(answers, "own", words), "other", words)
    answers = materialize(answers.select(
        "doc_id", "mark", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited")), "fingerprints")
    prints = answers.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.unhex("fingerprint").alias("next"))
    following = links.join(prints.dropDuplicates(["_id", "_mark"]), _same("next_id", "_id") & (F.col("next_mark") == F.col("_mark")))
    following = following.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.lower(F.hex("next")).alias("next"))
    paired = answers.join(following, _same("doc_id", "_id") & (F.col("mark") == F.col("_mark")))
    digits = F.lit(".{4}"), F.lit(0)
    paired = paired.withColumns({"_own": F.regexp_extract_all("fingerprint", *digits), "_next": F.regexp_extract_all("next", *digits)})
    return paired.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                         likeness(F.col("_own"), F.col("_next"), F.lit("0000")).alias("near_next"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
