"""Functions by their documented names: this library's, else Spark's, else those that a user has registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import builtin, cards, domain, finance, records, risk, runtime
from tidewright.operators import windows


def _running(of: Callable, value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """An aggregate over a key's rows so far."""
    return of(value).over(windows.running(keys, order))


#: Documented names whose function has another name here or in Spark.
RENAMED: dict[str, Callable] = {
    "log": F.ln, "mod": lambda a, b: a % b, "power": F.pow, "min": runtime.smaller, "max": runtime.larger,
    "trim_left": F.ltrim, "trim_right": F.rtrim, "pad_left": F.lpad, "pad_right": F.rpad, "regex_replace": F.regexp_replace, "regex_extract": F.regexp_extract, "join": F.array_join,
    "now": F.current_timestamp, "today": F.current_date, "day": F.dayofmonth, "day_of_week": runtime.day_of_week, "day_of_year": F.dayofyear, "date_diff": builtin.days_between, "parse_date": F.to_date, "parse_timestamp": F.to_timestamp,
    "to_integer": runtime.to_long, "to_string": lambda c: c.cast("string"), "type_of": F.typeof, "is_null": lambda c: c.isNull(), "is_not_null": lambda c: c.isNotNull(), "null_if": F.nullif, "if_null": F.coalesce, "first": lambda a: F.get(a, F.lit(0)), "last": lambda a: F.try_element_at(a, F.lit(-1)),
    "array_get": builtin.at, "array_length": F.size, "array_first": lambda a: F.get(a, F.lit(0)), "array_last": lambda a: F.try_element_at(a, F.lit(-1)), "array_is_empty": lambda a: F.coalesce(F.size(a) == 0, F.lit(True)), "array_remove_value": F.array_remove, "array_concat": F.concat, "array_slice": F.slice, "array_take": builtin.take, "array_drop": builtin.skip, "array_map": F.transform, "array_filter": F.filter, "array_reduce": F.aggregate, "array_flat_map": lambda a, f: F.flatten(F.transform(a, f)), "array_group_by": builtin.group_by, "array_partition": builtin.partition, "array_sort_by": builtin.sort_by, "array_intersect": F.array_intersect, "array_difference": F.array_except, "array_reverse": F.reverse, "array_shuffle": F.shuffle,
    "map_get": lambda m, k: F.try_element_at(m, k), "map_contains_value": lambda m, v: F.array_contains(F.map_values(m), v), "map_size": F.size, "map_merge": F.map_concat, "map_create": F.create_map, "array_to_map": F.map_from_entries,
    "deep_get": F.get_json_object, "deep_equals": runtime.equals, "record_to_json": F.to_json,
    "hash": runtime.salted_hash, "calculate_distance_km": domain.haversine_km, "calculate_utilization": finance.utilization, "pattern_deviation_score": risk.deviation, "weighted_risk_score": risk.weighted_score, "risk_level_from_score": risk.risk_level, "is_pci_compliant_log": cards.is_safe_to_log, "amount_in_minor_units": finance.minor_units, "amount_from_minor_units": finance.from_minor_units,
    "current_year": lambda: F.year(F.current_date()), "current_month": lambda: F.month(F.current_date()), "format_date": builtin.date_format, "format_timestamp": builtin.date_format, "is_before": lambda a, b: a < b, "is_after": lambda a, b: a > b,
    "parse_decimal": runtime.to_decimal, "parse_boolean": runtime.to_boolean, "is_string": lambda c: F.typeof(c) == "string", "is_date": lambda c: c.try_cast("date").isNotNull(), "min_of": lambda *c: F.least(*c) if len(c) > 1 else F.array_min(c[0]), "max_of": lambda *c: F.greatest(*c) if len(c) > 1 else F.array_max(c[0]),
    "map": F.transform, "sort": F.sort_array, "sort_desc": builtin.sort_descending, "distinct": F.array_distinct, "if": builtin.if_, "uuid_to_string": lambda c: c.cast("string"),
    "field_get": records._at, "field_get_or": records.get_or, "field_exists": records.has_field, "field_set": records.put, "field_remove": records.remove, "field_rename": records.rename, "field_move": records.move,
    "record_create": records.create, "record_merge_deep": records.merge_deep, "record_flatten": records.flatten, "record_unflatten": records.unflatten, "record_keys": records.keys, "record_keys_deep": lambda kind: records.keys(kind, deep=True), "record_values": records.values, "record_entries": records.entries, "record_size": lambda kind: len(kind.names), "record_is_empty": lambda kind: not kind.names,
    "array_get_or": builtin.get_or, "array_remove_all": builtin.remove_values, "array_set": builtin.set_at, "array_take_last": builtin.take_last, "array_drop_last": builtin.drop_last, "array_index_of": builtin.index_in, "array_last_index_of": builtin.last_index_in, "array_find": builtin.find, "array_find_index": builtin.find_index, "array_any": builtin.any_match, "array_all": builtin.all_match, "array_none": builtin.none_match, "array_sort_desc": builtin.sort_descending, "array_sort_by_desc": lambda a, key: builtin.sort_by(a, key, True), "array_distinct_by": builtin.distinct_by, "array_symmetric_diff": builtin.symmetric_difference,
    "map_remove_all": lambda m, keys: builtin.map_remove(m, *keys), "map_is_empty": lambda m: F.coalesce(F.size(m) == 0, F.lit(True)), "map_map_values": F.transform_values, "map_map_keys": F.transform_keys,
    "deep_set": records.put, "deep_remove": records.remove, "deep_merge": records.merge_deep, "deep_copy": lambda c: c, "project": builtin.record_pick, "validate_schema": records.violations, "coerce_to_schema": records.coerce, "schema_fields": records.keys, "schema_field_type": records.field_type, "schema_required_fields": records.required_fields, "to_json_pretty": lambda c: F.to_json(c, {"pretty": "true"}),
    **{f"is_{network}": partial(cards.is_network, name=network) for network, _ in cards.NETWORKS},
    "apply_payment_allocation": finance.allocate_payment, "recommended_utilization_target": finance.utilization_target, "burst_detection_score": risk.burst_score, "calculate_distance_miles": lambda *places: risk.miles(domain.haversine_km(*places)), "travel_velocity_kmh": risk.speed_kmh, "is_high_risk_country": risk.listed, "country_risk_score": risk.score_of, "is_high_risk_mcc": risk.listed, "mcc_risk_score": risk.score_of, "mcc_category": risk.merchant_kind,
    **{f"is_{kind}_mcc": partial(risk.is_merchant, kind=kind) for kind in ("gambling", "cash_equivalent", "high_chargeback")},
    "is_dormant_account": risk.is_dormant, "combine_risk_factors": risk.combine, "is_valid_currency_code": lambda c: F.coalesce(c.isin(*finance.SYMBOLS), F.lit(False)), "currency_decimal_places": finance.decimal_places, "is_zero_decimal_currency": finance.is_zero_decimal, "calculate_regulation_e_liability": finance.debit_liability, "is_within_dispute_window": finance.within_dispute_window,
    "variance_pop": F.var_pop, "collect_list_limit": windows.first_values,
    **{f"running_{name}": partial(_running, of) for name, of in (("sum", F.sum), ("count", F.count), ("avg", F.avg), ("min", F.min), ("max", F.max))},
}
_registered: dict[str, Callable] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """A user's function under a name; it may not hide one that is there."""
    if name in RENAMED or _find(name) is not None:
        raise ValueError(f"{name} is there already")
    _registered[name] = function


def _find(name: str) -> Callable | None:
    plain = name.removeprefix("calculate_")
    for module in (builtin, runtime, cards, finance, risk, domain, records, windows):
        for n in (name, plain):
            found = vars(module).get(n)
            if callable(found) and getattr(found, "__module__", "") == module.__name__:
                return found
    return getattr(F, name, None)


def function(name: str) -> Callable[..., Column]:
    """The function of a documented name (snake_case or camelCase)."""
    snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
    for n in (name, snake):
        found = RENAMED.get(n) or _registered.get(n) or _find(n)
        if found is not None:
            return found
    raise KeyError(f"no function named {name!r}")
