"""Scalar functions with fixed null rules, as Column expressions.

Every function takes and gives Columns, stays in the JVM and spells out what a
null does, since that differs from plain SQL in many places: predicates are
never null, a text's length is 0 without a text, parts of a date are -1
without a date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


#: What trimming takes off, all signs up to the space.
_BLANKS = "".join(map(chr, range(0x21)))


def _trimmed(s) -> Column:
    return F.btrim(_col(s), F.lit(_BLANKS))


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- numbers ------------------------------------------------------------------
def smaller(a, b) -> Column:
    """The lesser of two; a null is passed over."""
    return F.least(_col(a), _col(b))


def larger(a, b) -> Column:
    return F.greatest(_col(a), _col(b))


def power(base, exponent: int) -> Column:
    """Whole powers, as repeated multiplication would give them."""
    out = F.lit(1)
    for _ in range(exponent):
        out = out * _col(base)
    return out


def percent_of(value, percent) -> Column:
    return F.round(_col(value) * _col(percent) / 100, 10)


# -- texts --------------------------------------------------------------------
def length(s) -> Column:
    return F.coalesce(F.length(_col(s)), F.lit(0))


def concat(*parts) -> Column:
    """Nulls are passed over."""
    return F.concat_ws("", *(_col(p).cast("string") for p in parts))


def substring(s, start: int, end: int | None = None) -> Column:
    """From `start` (0-based) up to `end` (exclusive); both are clamped to the text."""
    s = _col(s)
    size = F.length(s)
    low = F.least(F.greatest(F.lit(start), F.lit(0)), size)
    high = size if end is None else F.least(F.greatest(F.lit(end), F.lit(0)), size)
    return F.substr(s, low + 1, F.greatest(high - low, F.lit(0)))


def starts_with(s, prefix) -> Column:
    return false_if_null(F.startswith(_col(s), _col(prefix)))


def ends_with(s, suffix) -> Column:
    return false_if_null(F.endswith(_col(s), _col(suffix)))


def contains(s, part) -> Column:
    return false_if_null(F.contains(_col(s), _col(part)))


def replace(s, old, new) -> Column:
    """Without an `old` nothing changes; without a `new` the old goes."""
    return F.when(_col(old).isNull(), _col(s)).otherwise(F.replace(_col(s), _col(old), F.coalesce(_col(new), F.lit(""))))


def is_empty(s) -> Column:
    return F.coalesce(_col(s) == "", F.lit(True))


def is_blank(s) -> Column:
    return F.coalesce(_trimmed(s) == "", F.lit(True))


def matches(s, pattern: str) -> Column:
    """The whole text matches."""
    return false_if_null(_col(s).rlike(rf"\A(?:{pattern})\z"))


# -- dates --------------------------------------------------------------------
def _part(c: Column) -> Column:
    return F.coalesce(c, F.lit(-1))


def hour(t) -> Column:
    return _part(F.hour(t))


def day_of_week(d) -> Column:
    """Monday is 1."""
    return _part(F.weekday(d) + 1)


def day_of_month(d) -> Column:
    return _part(F.dayofmonth(d))


def month(d) -> Column:
    return _part(F.month(d))


def year(d) -> Column:
    return _part(F.year(d))


def days_between(start, end) -> Column:
    """Whole days from start to end; 0 without one of them."""
    return F.coalesce(F.datediff(end, start), F.lit(0))


def whole_days_between(start, end) -> Column:
    """As days_between for instants: full periods of 24 hours."""
    seconds = F.unix_timestamp(_col(end).cast("timestamp")) - F.unix_timestamp(_col(start).cast("timestamp"))
    return F.coalesce(F.when(seconds < 0, -F.floor(-seconds / 86400)).otherwise(F.floor(seconds / 86400)), F.lit(0))


def add_days(d, n) -> Column:
    return F.date_add(d, n)


def business_date(d) -> Column:
    """Saturday and Sunday roll on to Monday."""
    late = F.weekday(d)
    return F.date_add(F.to_date(d), F.when(late >= 5, 7 - late).otherwise(0))


def is_business_day(d) -> Column:
    return false_if_null(F.weekday(d) < 5)


def business_date_offset(d, n: int) -> Column:
    """`n` business days after the (rolled) date, weekends only."""
    start = business_date(d)
    at = F.weekday(start) + n
    return F.date_add(start, (n + 2 * F.floor(at / 5)).cast("int"))


# -- comparison ---------------------------------------------------------------
def between(v, low, high) -> Column:
    return false_if_null(_col(v).between(_col(low), _col(high)))


def equals(a, b) -> Column:
    return _col(a).eqNullSafe(_col(b))


def differs(a, b) -> Column:
    """Not equal, where a null differs from every value."""
    return ~_col(a).eqNullSafe(_col(b))


def compare(a, b) -> Column:
    """-1, 0 or 1; a null comes first."""
    a, b = _col(a), _col(b)
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def member(v, values: list) -> Column:
    """In the list; a null is a member of a list that has one."""
    found = false_if_null(_col(v).isin([x for x in values if x is not None]))
    return found | _col(v).isNull() if None in values else found


def not_member(v, values: list) -> Column:
    return ~member(v, values)


# -- conversion ---------------------------------------------------------------
def to_long(s) -> Column:
    return _trimmed(s).try_cast("bigint")


def to_decimal(s, kind: str = "decimal(38,10)") -> Column:
    return _trimmed(s).try_cast(kind)


def to_boolean(s) -> Column:
    """"true", "yes" and "1" are true, all else is false."""
    return false_if_null(F.lower(_trimmed(s)).isin("true", "yes", "1"))


# -- protection ---------------------------------------------------------------
def salted_hash(v, salt="") -> Column:
    return F.sha2(F.concat(_col(salt), _col(v)), 256)


def mask(v, pattern: str) -> Column:
    """Letter by letter along the pattern: # keeps, * stars, anything else is put in as it is. Ends with the shorter of both."""
    v = _col(v)
    pieces = []
    used = 0
    for sign in pattern:
        if sign in "#*":
            letter = F.substr(v, F.lit(used + 1), F.lit(1))
            pieces.append(F.when(F.length(v) > used, letter if sign == "#" else F.lit("*")).otherwise(F.lit("")))
            used += 1
        else:
            pieces.append(F.when(F.length(v) > used, F.lit(sign)).otherwise(F.lit("")))
    return F.when(v.isNotNull(), F.concat(*pieces))
