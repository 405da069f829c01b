"""Column functions. Each takes and returns Columns and stays inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a JavaScript runtime treats as white space when trimming or parsing numbers.
WEB_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
MAX_LONG = 9223372036854775807
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def leading_int(text: Column) -> Column:
    """The integer a text starts with, or null. Values past 64 bits saturate."""
    digits = F.regexp_extract(text, rf"^[{WEB_SPACE}]*([+-]?[0-9]+)", 1)
    large = digits.try_cast("double")
    return F.coalesce(
        digits.try_cast("bigint"),
        F.when(large < 0, F.lit(-MAX_LONG)).when(large < float("inf"), F.lit(MAX_LONG)))


def web_trim(text: Column) -> Column:
    """Strip all white space from both ends (SQL trim strips blanks only)."""
    return F.regexp_replace(text, rf"^[{WEB_SPACE}]+|[{WEB_SPACE}]+$", "")


def number_or_zero(name: str) -> Column:
    """A column as finite doubles, with 0 for nulls, NaN, infinities and text that is no number."""
    number = F.col(name).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number).otherwise(F.lit(0.0)).alias(name)


def as_number(name: str) -> Column:
    """A column as doubles; null for text that is no number and for NaN, which counts as missing."""
    return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))


def time_text(moment: Column) -> Column:
    return F.date_format(moment, TIME_TEXT)


def fulfillment_status(shipment_count: Column) -> Column:
    return F.when(shipment_count > 0, F.lit("Shipped")).otherwise(F.lit("Open"))


def clean_name(name: Column) -> Column:
    return F.trim(F.coalesce(name, F.lit("")))


def _time_of_day(moment: Column) -> Column:
    return moment - moment.cast("date").cast("timestamp_ntz")


def customer_age(order_datetime: Column, birthdate: Column) -> Column:
    """Whole days from birth to order, floor-divided by 365; null if either date is unusable."""
    ordered = order_datetime.try_cast("timestamp_ntz")
    born = birthdate.try_cast("timestamp_ntz")
    days = F.date_diff(ordered.cast("date"), born.cast("date")) - F.when(
        _time_of_day(ordered) < _time_of_day(born), 1
    ).otherwise(0)
    return F.floor(days / F.lit(365.0)).cast("double")


# Multipliers of the deterministic risk hash.
ORDER_FACTOR, CUSTOMER_FACTOR, CENTS_FACTOR = 374761, 66041, 104729
WORD = 4294967296
# Where the digits of each part stand in the time text, and the codes of the signs between them.
TIME_DIGITS = [(F.year, (1, 2, 3, 4)), (F.month, (6, 7)), (F.day, (9, 10)),
               (F.hour, (12, 13)), (F.minute, (15, 16)), (F.second, (18, 19))]
TIME_SIGNS = {5: "-", 8: "-", 11: " ", 14: ":", 17: ":"}


def _text_codes(text: Column) -> Column:
    """Sum of character code times 1-based position."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        F.lit(0).cast("bigint"),
        lambda total, at: total + F.ascii(F.substr(text, at, F.lit(1))) * at)


def _time_codes(moment: Column) -> Column:
    """`_text_codes` of the time text, from the parts of the time: compiled integer arithmetic."""
    fixed = sum(ord(sign) * at for at, sign in TIME_SIGNS.items())
    fixed += sum(ord("0") * at for _, places in TIME_DIGITS for at in places)
    total = F.lit(fixed)
    for part, places in TIME_DIGITS:
        for power, at in enumerate(reversed(places)):
            total = total + F.floor(part(moment) / F.lit(10 ** power)) % 10 * at
    return total


def _score(order_id: Column, customer_id: Column, total: Column, codes: Column) -> Column:
    """Nulls and NaN count as 0. All sums are exact; in doubles they would be rounded beyond 2^53."""
    def or_zero(number: Column) -> Column:
        return F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))

    shifted = F.coalesce(F.nanvl(total.cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(100.0) + F.lit(0.5)
    parts = ((or_zero(order_id), ORDER_FACTOR), (or_zero(customer_id), CUSTOMER_FACTOR))
    # A double from 2^53 on is a whole number.
    cents = F.when(F.abs(shifted) < F.lit(float(2**53)), F.pmod(F.floor(shifted), F.lit(WORD))).when(
        F.abs(shifted) < F.lit(float("inf")), F.pmod(shifted, F.lit(float(WORD))).cast("bigint")).otherwise(F.lit(0))
    wrapped = cents * F.lit(CENTS_FACTOR)
    for number, factor in parts:
        wrapped = wrapped + F.pmod(number, F.lit(WORD)) * F.lit(factor)
    # Without a time text nothing wraps the sum to 32 bits.
    plain = F.when(F.abs(shifted) < F.lit(1e30), F.floor(shifted.cast("decimal(38,2)")).cast("decimal(31,0)")) * F.lit(CENTS_FACTOR)
    for number, factor in parts:
        plain = plain + number.cast("decimal(20,0)") * F.lit(factor)
    rest = F.coalesce((F.pmod(wrapped + codes, F.lit(WORD)) % F.lit(10000)).cast("double"), (plain % F.lit(10000)).cast("double"))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), rest / F.lit(10000.0)))


def hash_score(order_id: Column, customer_id: Column, total: Column, time: Column) -> Column:
    """Deterministic stand-in for a fraud probability, between 0.01 and 0.99; `time` is a text."""
    return _score(order_id, customer_id, total, F.when(time != "", _text_codes(time)))


def hash_score_at(order_id: Column, customer_id: Column, total: Column, moment: Column) -> Column:
    """`hash_score` for a timestamp, as if it were written as yyyy-MM-dd HH:mm:ss."""
    plain = F.year(moment).between(0, 9999)
    codes = F.when(plain, _time_codes(moment)).when(moment.isNotNull(), _text_codes(time_text(moment)))
    return _score(order_id, customer_id, total, codes)
