"""Parsing of values that come as text: dates, quantities, check digits. What can't be read is told, not guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a unit's suffix stands for.
COUNTS = {"": 1, "k": 1_000, "m": 1_000_000, "b": 1_000_000_000}
BYTES = {"b": 1, "kib": 1024, "mib": 1024**2, "gib": 1024**3}
DURATIONS_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def parse_date(text: Column) -> Column:
    """A struct of shape (iso, compact, slashed) and days since 1970; shape is "ambiguous" where day and month could change places, "unknown" for no known shape, and days are then null. So are the days of dates that don't exist."""
    clean = F.trim(text)
    part = lambda pattern, k: F.regexp_extract(clean, pattern, k)
    iso, compact, year_first, year_last = r"^(\d{4})-(\d+)-(\d+)$", r"^(\d{4})(\d\d)(\d\d)$", r"^(\d{4})/(\d+)/(\d+)$", r"^(\d+)/(\d+)/(\d{4})$"
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    days = lambda y, m, d: F.unix_date(F.to_date(F.try_to_timestamp(F.concat_ws("-", y, two(m), two(d)), F.lit("yyyy-MM-dd"))))
    in_order = lambda p: days(part(p, 1), part(p, 2), part(p, 3))
    a, b = part(year_last, 1).cast("int"), part(year_last, 2).cast("int")
    unclear = (a <= 12) & (b <= 12) & (a != b)
    told = lambda shape, value: F.struct(F.lit(shape).alias("shape"), value.alias("days"))
    none = F.lit(None).cast("int")
    last = F.when(unclear, told("ambiguous", none)).when(a > 12, told("slashed", days(part(year_last, 3), part(year_last, 2), part(year_last, 1)))).otherwise(told("slashed", days(part(year_last, 3), part(year_last, 1), part(year_last, 2))))
    return (
        F.when(clean.rlike(iso), told("iso", in_order(iso)))
        .when(clean.rlike(compact), told("compact", in_order(compact)))
        .when(clean.rlike(year_first), told("slashed", in_order(year_first)))
        .when(clean.rlike(year_last), last)
        .otherwise(told("unknown", none))
    )


def parse_quantity(text: Column, units: dict[str, int]) -> Column:
    """The number in the smallest unit; null without a number, for an unknown unit, and where it isn't whole."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9.]+)", 1)
    unit = F.trim(F.regexp_replace(clean, r"^[0-9.]+", ""))
    scale = reduce(lambda c, kv: c.when(unit == kv[0], F.lit(kv[1])), list(units.items())[1:], F.when(unit == next(iter(units)), F.lit(next(iter(units.values())))))
    value = F.when(number.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.cast("double")) * scale
    return F.when(value == F.floor(value), value.cast("long"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one's weight being one."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))


def stamp(number: Column) -> Column:
    """The number and its check digit; null for negative numbers."""
    body = number.cast("string")
    return F.when(number >= 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))


def verify(stamped: Column) -> Column:
    """The number of a stamped one; null where the check digit is wrong or there is none."""
    clean = F.trim(stamped)
    return F.when(clean.rlike(r"^[0-9]{2,}$") & (_luhn(clean) % 10 == 0), F.substring(clean, F.lit(1), F.length(clean) - 1).cast("long"))
