"""Null and edge rules of the function libraries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions import builtin as b
from tidewright.functions import domain as dm
from tidewright.functions import runtime as rt


@pytest.fixture(scope="module")
def one(spark):
    row = [("Hello", None, 7, 3, dt.date(2024, 3, 2), dt.datetime(2024, 3, 2, 13, 5), None, [3.0, None, 1.0], None, [], {"a": 1})]
    return spark.createDataFrame(row, "s string, n string, i int, j int, d date, t timestamp, nd date, l array<double>, nl array<double>, el array<double>, m map<string,int>")


def cases():
    S, N, D, ND, L, NL, EL, M = (F.col(c) for c in ("s", "n", "d", "nd", "l", "nl", "el", "m"))
    return {
        "length null": (rt.length(N), 0), "length": (rt.length(S), 5), "concat skips nulls": (rt.concat(S, N, S), "HelloHello"),
        "substring": (rt.substring(S, 1, 3), "el"), "substring clamps": (rt.substring(S, -4, 99), "Hello"), "substring inverted": (rt.substring(S, 3, 1), ""), "substring null": (rt.substring(N, 0, 1), None),
        "starts null": (rt.starts_with(N, "H"), False), "ends": (rt.ends_with(S, "lo"), True), "contains null part": (rt.contains(S, N), False),
        "replace null old": (rt.replace(S, N, "x"), "Hello"), "replace null new": (rt.replace(S, "l", N), "Heo"), "empty null": (rt.is_empty(N), True), "blank": (rt.is_blank(F.lit("  ")), True),
        "matches is full": (rt.matches(S, "ell"), False), "matches": (rt.matches(S, "H.*o"), True),
        "hour": (rt.hour(F.col("t")), 13), "weekday": (rt.day_of_week(D), 6), "weekday null": (rt.day_of_week(ND), -1), "year null": (rt.year(ND), -1),
        "days": (rt.days_between(D, F.date_add(D, 9)), 9), "days null": (rt.days_between(D, ND), 0), "24h units": (rt.whole_days_between(F.lit("2024-03-02 13:00:00"), F.lit("2024-03-01 14:00:00")), 0),
        "business date": (rt.business_date(D), dt.date(2024, 3, 4)), "is business": (rt.is_business_day(D), False), "business null": (rt.is_business_day(ND), False), "offset": (rt.business_date_offset(D, 5), dt.date(2024, 3, 11)), "offset back": (rt.business_date_offset(D, -1), dt.date(2024, 3, 1)),
        "between null": (rt.between(N, 1, 2), False), "equals nulls": (rt.equals(N, N), True), "differs null": (rt.differs(N, "x"), True), "compare null": (rt.compare(N, S), -1), "compare": (rt.compare(F.col("i"), F.col("j")), 1),
        "member null": (rt.member(N, ["a", None]), True), "not member null": (rt.not_member(N, ["a"]), True), "min skips null": (rt.smaller(F.lit(None), F.col("j")), 3),
        "to long": (rt.to_long(F.lit(" 12 ")), 12), "to long bad": (rt.to_long(F.lit("1x")), None), "to long blank": (rt.to_long(F.lit(" ")), None), "to bool": (rt.to_boolean(F.lit("Yes ")), True), "to bool null": (rt.to_boolean(N), False),
        "mask": (rt.mask(F.lit("123456"), "##-**"), "12-**"), "mask short": (rt.mask(F.lit("1"), "##-#"), "1"), "mask null": (rt.mask(N, "#"), None), "power": (rt.power(F.col("j"), 4), 81),
        "any null": (b.any_match(NL, lambda x: x > 0), False), "all empty": (b.all_match(EL, lambda x: x > 0), True), "all null": (b.all_match(NL, lambda x: x > 0), True), "none null": (b.none_match(NL, lambda x: x > 0), True),
        "sum": (b.list_sum(L), 4.0), "sum null": (b.list_sum(NL), 0.0), "avg": (b.list_avg(L), 2.0), "avg empty": (b.list_avg(EL), 0.0), "find": (b.find(L, lambda x: x < 2), 1.0), "at out of range": (b.at(L, 9), None),
        "sort desc": (b.sort_by(F.array(F.lit(2), F.lit(3), F.lit(1)), lambda x: x, True), [3, 2, 1]), "skip all": (b.skip(EL, 3), []), "index": (b.index_in(F.array(F.lit("x"), F.lit("y")), "y"), 1), "index none": (b.index_in(F.array(F.lit("x")), "z"), -1),
        "remove at": (b.remove_at(F.array(F.lit(1), F.lit(2), F.lit(3)), 1), [1, 3]), "set at": (b.set_at(F.array(F.lit(1), F.lit(2)), 0, F.lit(9)), [9, 2]), "symmetric": (b.symmetric_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), [1, 3]),
        "map get": (b.map_get_or(M, "z", 5), 5), "map put": (b.map_put(M, "a", 9), {"a": 9}), "map remove": (b.map_remove(M, "a"), {}), "invert": (b.map_invert(M), {1: "a"}),
        "truncate": (b.truncate(F.lit(-2.79), 1), -2.7), "clamp": (b.clamp(F.lit(12), 0, 10), 10), "change of 0": (b.percent_change(F.lit(0.0), F.lit(1.0)), None), "capitalize": (b.capitalize(F.lit("hELLO")), "Hello"), "first only": (b.replace_first(S, "l", "L"), "HeLlo"), "index of": (b.index_of(S, "z"), -1),
    }


def test_rules(one):
    wrong = {}
    for name, (column, want) in cases().items():
        got = one.select(column.alias("x")).first()["x"]
        if not (got == pytest.approx(want) if isinstance(want, float) else got == want):
            wrong[name] = (got, want)
    assert not wrong


def test_add_business_days(spark):
    days = dm.calendar(spark, "2024-02-01", "2024-04-01", ["2024-03-05"])
    df = spark.createDataFrame([(dt.date(2024, 3, 1),), (dt.date(2024, 3, 2),)], "d date")
    got = {r.d: r.x for r in dm.add_business_days(df, days, "d", 2, "x").collect()}
    assert got == {dt.date(2024, 3, 1): dt.date(2024, 3, 6), dt.date(2024, 3, 2): dt.date(2024, 3, 6)}


def test_edges_of_texts_and_numbers(spark):
    from tidewright.functions import builtin, runtime

    df = spark.createDataFrame([(1, "\t\n", "abc\n", 0.29), (2, " \tyes\r\n", "abc", -1.999), (3, None, None, None), (4, "\t42\n", "xabc", 1e30)], "i int, s string, m string, v double")
    got = {r.i: r for r in df.select("i", runtime.is_blank(F.col("s")).alias("blank"), runtime.to_boolean(F.col("s")).alias("yes"), runtime.to_long(F.col("s")).alias("long"), runtime.matches(F.col("m"), "abc|x").alias("whole"), builtin.truncate(F.col("v"), 2).alias("cut")).collect()}
    assert [got[i].blank for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert [got[i].yes for i in (1, 2, 3, 4)] == [False, True, False, False] and got[4].long == 42
    assert [got[i].whole for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert [got[i].cut for i in (1, 2, 3)] == [0.29, -1.99, None] and got[4].cut > 9e29


#: Documented names of the groups that have other names in this library.
NAMES = {
    "scalars": "current_year current_month add_years add_hours add_minutes format_date format_timestamp is_before is_after end_of_day parse_decimal parse_boolean is_string is_date min_of max_of map sort sort_desc distinct if case_when switch uuid_from_string uuid_to_string",
    "records": "field_get field_get_or field_exists field_type field_set field_remove field_rename field_move record_create record_merge_deep record_flatten record_unflatten record_keys record_keys_deep record_values record_entries record_size record_is_empty deep_set deep_remove deep_merge deep_copy query query_first query_paths project reshape validate_schema is_valid coerce_to_schema schema_fields schema_field_type schema_required_fields to_json_pretty",
    "lists": "array_get_or array_remove_all array_set array_take_last array_drop_last array_index_of array_last_index_of array_find array_find_index array_any array_all array_none array_sort_desc array_sort_by_desc array_distinct_by array_symmetric_diff map_put_all map_remove_all map_is_empty map_map_values map_map_keys",
    "domain": "is_visa is_mastercard is_amex is_discover is_diners is_jcb is_unionpay apply_payment_allocation recommended_utilization_target burst_detection_score calculate_distance_miles travel_velocity_kmh is_high_risk_country country_risk_score is_high_risk_mcc mcc_risk_score mcc_category is_gambling_mcc is_cash_equivalent_mcc is_high_chargeback_mcc is_dormant_account combine_risk_factors is_valid_currency_code currency_decimal_places is_zero_decimal_currency calculate_regulation_e_liability is_within_dispute_window",
    "windows": "variance_pop first_value_by last_value_by sum_if avg_if min_if max_if collect_list_limit running_sum running_count running_avg running_min running_max",
}


@pytest.mark.parametrize("group", NAMES)
def test_documented_names_resolve(group):
    from tidewright.functions import names

    for name in NAMES[group].split():
        assert callable(names.function(name)), name


def test_functions_by_documented_names(spark):
    from pyspark.sql.types import StructType

    from tidewright.functions import names

    f = names.function
    df = spark.sql("SELECT array(3, 1, 2, 3) AS a, map('x', 1, 'y', 2) AS m, map('y', 5) AS o, named_struct('p', 1, 'q', named_struct('r', 'z')) AS rec, '4111111111111111' AS pan, timestamp '2024-02-29 10:00:00' AS t, '{\"k\": [7, 8]}' AS j, named_struct('n', '12', 'w', 'x1', 'u', CAST(NULL AS STRING)) AS raw")
    a, m, rec, kind = F.col("a"), F.col("m"), F.col("rec"), df.schema["rec"].dataType
    schema = StructType.fromDDL("n int, w int, u string NOT NULL")
    got = df.select(
        f("array_take_last")(a, 2).alias("last2"), f("array_drop_last")(a, 3).alias("drop3"), f("array_last_index_of")(a, 3).alias("at3"), f("array_find_index")(a, lambda x: x < 3).alias("under3"), f("array_distinct_by")(a, lambda x: x % 2).alias("odd_even"),
        f("array_remove_all")(a, [3]).alias("no3"), f("array_get_or")(a, 9, -1).alias("none"), f("map_put_all")(m, F.col("o")).alias("both"), f("map_remove_all")(m, ["x"]).alias("no_x"), f("map_map_values")(m, lambda k, v: v + 1).alias("more"),
        f("field_move")(rec, "p", "s").alias("moved"), f("record_values")(rec, kind).alias("values"), f("query_first")(F.col("j"), "$.k").alias("first"), f("reshape")(rec, {"deep": {"z": "q.r"}, "p": "p"}).alias("shaped"),
        f("validate_schema")(F.col("raw"), schema).alias("wrong"), f("is_visa")(F.col("pan")).alias("visa"), f("is_amex")(F.col("pan")).alias("amex"), f("end_of_day")(F.col("t")).alias("end"), f("add_years")(F.col("t"), 1).alias("year"), f("add_hours")(F.col("t"), 20).alias("later"),
        f("switch")(a[0], {1: "one", 3: "three"}, otherwise="many").alias("named"), f("if")(a[0] > 2, "large", "small").alias("size"), f("uuid_from_string")(F.lit("not one")).alias("uuid"), f("is_gambling_mcc")(F.lit("7995")).alias("bets"),
    ).first()
    assert (got.last2, got.drop3, got.at3, got.under3, got.odd_even, got.no3, got.none) == ([2, 3], [3], 3, 1, [3, 2], [1, 2], -1)
    assert got.both == {"x": 1, "y": 5} and got.no_x == {"y": 2} and got.more == {"x": 2, "y": 3}
    assert got.moved.s == 1 and "p" not in got.moved and got["values"] == ["1", "{z}"] and got.first == "7" and got.shaped.deep.z == "z"
    assert got.wrong == ["w: not int", "u: missing"] and got.visa and not got.amex and got.bets and got.uuid is None
    assert got.end == dt.datetime(2024, 2, 29, 23, 59, 59, 999999) and got.year == dt.date(2025, 2, 28) and got.later == dt.datetime(2024, 3, 1, 6)
    assert got.named == "three" and got.size == "large"
    assert names.function("query_paths")(kind, "q.*") == ["q.r"] and names.function("schema_required_fields")(schema) == ["u"] and names.function("field_type")(kind, "q.r") == "string"
    running = spark.sql("SELECT * FROM VALUES (1, 1), (1, 2), (2, 5) AS t(k, v)")
    assert sorted(r[0] for r in running.select(f("running_sum")(F.col("v"), ["k"], ["v"])).collect()) == [1, 3, 5]
