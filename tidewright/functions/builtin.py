"""The documented catalogue of scalar functions, as Column expressions (snake_case names, catalogue rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# -- numbers ------------------------------------------------------------------
def truncate(v: Column, digits: int = 0) -> Column:
    """Towards zero, in decimal arithmetic (0.29 has no exact double); values too large for it as doubles."""
    scale = 10**digits
    rough = F.when(F.abs(v) * scale < 2**53, F.signum(v) * F.floor(F.abs(v) * scale) / scale).otherwise(v.cast("double"))  # larger doubles are whole
    if digits < 0:
        return rough
    exact = F.signum(v) * F.floor(F.abs(v).try_cast("decimal(38,14)") * scale).cast("double") / scale
    return F.coalesce(exact, rough)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100, whole)


def percent_change(old: Column, new: Column) -> Column:
    return F.try_divide((new - old) * 100, old)


def simple_interest(principal: Column, rate: Column, years: Column) -> Column:
    return principal * rate * years


def compound_interest(principal: Column, rate: Column, years: Column, periods: int = 1) -> Column:
    return principal * F.pow(1 + rate / periods, years * periods) - principal


def annualize(rate: Column, periods: int) -> Column:
    return F.pow(1 + rate, F.lit(periods)) - 1


# -- texts --------------------------------------------------------------------
def substring(s: Column, start: int, size: int) -> Column:
    """`size` letters from `start` (0-based)."""
    return F.substr(s, F.lit(start + 1), F.lit(size))


def index_of(s: Column, part: str) -> Column:
    """0-based, -1 if absent."""
    return F.instr(s, part) - 1


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def title_case(s: Column) -> Column:
    return F.initcap(s)


def replace_first(s: Column, old: str, new: str) -> Column:
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.lit(new), F.substr(s, at + len(old)))).otherwise(s)


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


# -- dates --------------------------------------------------------------------
def date_format(d: Column, pattern: str) -> Column:
    """Patterns may use YYYY and DD."""
    return F.date_format(d, pattern.replace("YYYY", "yyyy").replace("DD", "dd"))


def days_between(d1: Column, d2: Column) -> Column:
    """d1 - d2."""
    return F.datediff(d1, d2)


def months_between_whole(d1: Column, d2: Column) -> Column:
    return F.floor(F.months_between(d1, d2)).cast("int")


def years_between(d1: Column, d2: Column) -> Column:
    return F.floor(F.months_between(d1, d2) / 12).cast("int")


def start_of_month(d: Column) -> Column:
    return F.to_date(F.trunc(d, "month"))


def end_of_month(d: Column) -> Column:
    return F.last_day(d)


def start_of_day(t: Column) -> Column:
    return F.date_trunc("day", t)


def is_same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def end_of_day(t: Column) -> Column:
    """The day's last microsecond."""
    return F.date_trunc("day", t) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def add_years(d: Column, n: int) -> Column:
    return F.add_months(d, 12 * n)


def add_hours(t: Column, n) -> Column:
    return F.timestamp_add("HOUR", n if isinstance(n, Column) else F.lit(n), t)


def add_minutes(t: Column, n) -> Column:
    return F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), t)


# -- choice -------------------------------------------------------------------
def if_(condition: Column, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def case_when(*cases, otherwise=None) -> Column:
    """Pairs (condition, value), the first that holds counts."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def switch(value: Column, cases: dict, otherwise=None) -> Column:
    return case_when(*((value == F.lit(k), v) for k, v in cases.items()), otherwise=otherwise)


def uuid_from_string(s: Column) -> Column:
    """In lower case, null if it is no UUID."""
    return F.when(s.rlike(r"\A[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"), F.lower(s))


# -- conversion and nulls -----------------------------------------------------
def parse_int(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def is_number(s: Column) -> Column:
    return F.coalesce(F.trim(s).try_cast("double").isNotNull(), F.lit(False))


def empty_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def null_to_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


# -- lists ----------------------------------------------------------------------
def _empty_as(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def any_match(a: Column, test) -> Column:
    """False without a list."""
    return _empty_as(F.exists(a, test), False)


def all_match(a: Column, test) -> Column:
    """True without a list or without elements."""
    return _empty_as(F.forall(a, test), True)


def none_match(a: Column, test) -> Column:
    return ~any_match(a, test)


def list_sum(a: Column) -> Column:
    """Nulls are passed over; 0 without a list."""
    return _empty_as(F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x), 0.0)


def list_avg(a: Column) -> Column:
    """0 without elements, else rounded to ten digits."""
    kept = F.filter(a, lambda x: x.isNotNull())
    return _empty_as(F.round(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept)), 10), 0.0)


def count_where(a: Column, test) -> Column:
    return _empty_as(F.size(F.filter(a, test)), 0)


def find(a: Column, test) -> Column:
    """The first element that passes."""
    return F.get(F.filter(a, test), F.lit(0))


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def skip(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a), F.lit(1)))


def at(a: Column, i) -> Column:
    """0-based; null out of range."""
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def sort_by(a: Column, key, descending: bool = False) -> Column:
    """Stable by key; a null key comes first, or last if descending."""
    pairs = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i if descending else i).alias("i"), x.alias("x")))
    ordered = F.array_sort(pairs)
    return F.transform(F.reverse(ordered) if descending else ordered, lambda p: p["x"])


def index_in(a: Column, value) -> Column:
    """0-based, -1 if absent."""
    return F.coalesce(F.array_position(a, value), F.lit(0)).cast("int") - 1


def remove_at(a: Column, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), F.slice(a, F.lit(i + 2), F.greatest(F.size(a), F.lit(1))))


def set_at(a: Column, i: int, value) -> Column:
    return F.transform(a, lambda x, n: F.when(n == i, value).otherwise(x))


def partition(a: Column, test) -> Column:
    """Two lists: those that pass, and the rest."""
    return F.struct(F.filter(a, test).alias("yes"), F.filter(a, lambda x: ~F.coalesce(test(x), F.lit(False))).alias("no"))


def group_by(a: Column, key) -> Column:
    """Map of key to the elements that have it."""
    keys = F.array_distinct(F.transform(a, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(a, lambda x: key(x).eqNullSafe(k))))


def get_or(a: Column, i: int, default) -> Column:
    return F.coalesce(F.get(a, F.lit(i)), F.lit(default))


def remove_values(a: Column, values: list) -> Column:
    """Without any of the values; nulls stay."""
    return F.filter(a, lambda x: ~F.coalesce(x.isin(list(values)), F.lit(False)))


def take_last(a: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(a), 1, n))


def drop_last(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def last_index_in(a: Column, value) -> Column:
    """0-based, -1 if absent."""
    back = F.coalesce(F.array_position(F.reverse(a), value), F.lit(0))
    return F.when(back > 0, F.size(a) - back).otherwise(-1).cast("int")


def find_index(a: Column, test) -> Column:
    """Place of the first element that passes, -1 without one."""
    return index_in(F.transform(a, lambda x: F.coalesce(test(x), F.lit(False))), True)


def distinct_by(a: Column, key) -> Column:
    """The first element of every key."""
    names = F.transform(a, lambda x: F.struct(key(x)))
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_position(names, F.struct(key(p["x"]))) == p["i"] + 1), lambda p: p["x"])


def sort_descending(a: Column) -> Column:
    return F.sort_array(a, asc=False)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


# -- maps -----------------------------------------------------------------------
def map_get_or(m: Column, key, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def map_put(m: Column, key, value) -> Column:
    """Whatever was there for the key is replaced."""
    kept = F.map_filter(m, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))


def map_remove(m: Column, *keys) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(list(keys)))


def map_put_all(m: Column, other: Column) -> Column:
    """Both maps; the other's values win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(other), k)), other)


def map_invert(m: Column) -> Column:
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


# -- records --------------------------------------------------------------------
def record_merge(a: Column, b: Column, a_fields: list[str], b_fields: list[str]) -> Column:
    """Fields of both; b's win."""
    return F.struct(*(a[f].alias(f) for f in a_fields if f not in b_fields), *(b[f].alias(f) for f in b_fields))


def record_pick(r: Column, fields: list[str]) -> Column:
    return F.struct(*(r[f].alias(f) for f in fields))


def record_omit(r: Column, fields: list[str]) -> Column:
    return r.dropFields(*fields)


def record_set(r: Column, field: str, value: Column) -> Column:
    return r.withField(field, value)
