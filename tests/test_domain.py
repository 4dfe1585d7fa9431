"""Cards, finance, risk, records and functions by name."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions import cards, finance, names, records, risk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rules():
    L, D = F.lit, lambda s: F.lit(s).cast("date")
    T = F.lit("2024-03-02 03:30:00").cast("timestamp")
    return {
        "luhn": (cards.luhn_validate(L("4532-0151 1283 0366")), True), "luhn bad": (cards.luhn_validate(L("4532015112830367")), False), "luhn text": (cards.luhn_validate(L("abc")), False),
        "check digit": (cards.luhn_checksum(L("453201511283036")), 6), "masked": (cards.mask_pan(L("4532015112830366")), "453201******0366"), "custom": (cards.mask_pan_custom(L("4532015112830366"), 4, 4, "X"), "4532XXXXXXXX0366"),
        "bin": (cards.extract_bin(L("4532 0151")), "453201"), "length": (cards.pan_length(L("45 32-0")), 5),
        "visa": (cards.identify_card_network(L("4532015112830366")), "visa"), "mc 2": (cards.identify_card_network(L("2720991234567890")), "mastercard"), "mc over": (cards.identify_card_network(L("2721001234567890")), None), "amex": (cards.is_network(L("371449635398431"), "amex"), True), "jcb": (cards.identify_card_network(L("3530111333300000")), "jcb"), "union": (cards.identify_card_network(L("6200000000000005")), "unionpay"), "diners": (cards.identify_card_network(L("30569309025904")), "diners"), "discover": (cards.identify_card_network(L("6011111111111117")), "discover"),
        "expiry": (cards.parse_expiry(L("12/25")), dt.date(2025, 12, 31)), "expiry plain": (cards.parse_expiry(L("0224")), dt.date(2024, 2, 29)), "expiry bad": (cards.parse_expiry(L("13/25")), None), "expired": (cards.is_expired(D("2024-02-29"), D("2024-03-01")), True), "soon": (cards.is_expiring_soon(D("2024-03-31"), 30, D("2024-03-02")), True), "format": (cards.format_expiry(D("2025-12-31")), "12/25"), "months": (cards.months_until_expiry(D("2024-06-30"), D("2024-03-31")), 3),
        "log": (cards.is_safe_to_log(L("pan 4532 0151 1283 0366")), False), "log ok": (cards.is_safe_to_log(L("order 12345")), True), "sanitized": (cards.sanitize_for_logging(L("x 4532015112830366 y")), "x [card] y"), "token": (F.length(cards.tokenize_pan(L("4532015112830366"), "s")), 16),
        "daily": (F.round(finance.daily_interest(L(1000.0), L(0.18)), 2), 0.49), "period": (F.round(finance.interest_for_period(L(1500.0), L(0.18), L(30)), 2), 22.19), "effective": (F.round(finance.effective_apr(L(0.18), 12), 4), 0.1956),
        "cash fee": (finance.cash_advance_fee(L(200.0), 0.05, 10, 50), 10.0), "late": (finance.late_fee(L(15), [(1, 9, 10), (10, None, 30)], 5, 32), 32.0), "late not due": (finance.late_fee(L(0), [(1, None, 10)]), 0.0), "waived": (finance.late_fee(L(3), [(1, None, 10)], waived=L(True)), 0.0),
        "minimum": (finance.minimum_payment(L(3500.0), 0.02, 25, L(52.5), L(0.0)), 122.5), "minimum small": (finance.minimum_payment(L(10.0), 0.02, 25, L(0.0), L(0.0)), 10.0), "months to pay": (finance.payoff_months(L(5000.0), L(0.18), L(150.0)), 47), "never": (finance.payoff_months(L(5000.0), L(0.18), L(75.0)), None), "no interest": (finance.payoff_months(L(100.0), L(0.0), L(30.0)), 4),
        "tier": (finance.utilization_tier(L(25.0)), "good"), "tier edge": (finance.utilization_tier(L(100.0)), "critical"), "tier over": (finance.utilization_tier(L(100.1)), "overlimit"), "available": (finance.available_credit(L(10000.0), L(2500.0), L(150.0)), 7350.0), "no limit": (finance.utilization(L(5.0), L(0.0)), None),
        "round": (finance.round_to_currency(L(123.456), L("USD")), 123.46), "round yen": (finance.round_to_currency(L(123.6), L("JPY")), 124.0), "valid": (finance.is_valid_amount(L(123.456), L("USD")), False), "valid 2": (finance.is_valid_amount(L(123.45), L("USD")), True), "cents": (finance.minor_units(L(123.45), L("USD")), 12345), "yen": (finance.minor_units(L(1234), L("JPY")), 1234), "back": (finance.from_minor_units(L(12345), L("USD")), 123.45), "shown": (finance.format_currency(L(1234.56), L("USD")), "$1,234.56"), "shown yen": (finance.format_currency(L(1234), L("JPY")), "¥1,234"), "other": (finance.currency_symbol(L("SEK")), "SEK"),
        "liability": (finance.debit_liability(L(5000.0), L(2)), 50.0), "liability 45": (finance.debit_liability(L(5000.0), L(45)), 500.0), "liability late": (finance.debit_liability(L(5000.0), L(61)), 5000.0),
        "velocity": (F.round(risk.velocity_score(L(5), 3), 2), 66.67), "breach": (risk.is_velocity_breach(L(5), 3), True), "burst": (risk.burst_score(L(8), L(2.0)), 75.0), "usual": (F.round(risk.velocity_percentile(L(3), L(3.0), L(1.0)), 3), 50.0),
        "travel": (risk.is_impossible_travel(L(3935.0), L(2.0)), True), "speed": (risk.speed_kmh(L(3935.0), L(2.0)), 1967.5), "same time": (risk.travel_verdict(L(5.0), L(0.0)), "impossible"), "train": (risk.travel_verdict(L(250.0), L(1.0)), "suspicious"), "still": (risk.travel_verdict(L(0.0), L(0.0)), "possible"),
        "gambling": (risk.is_merchant(L("7995"), "gambling"), True), "kind": (risk.merchant_kind(L("6051")), "cash_equivalent"), "score of": (risk.score_of(L("NG"), {"NG": 80.0}, 5), 80.0), "listed null": (risk.listed(L(None), ["NG"]), False),
        "odd": (risk.is_odd_hours(T, 2, 5), True), "odd there": (risk.is_odd_hours(T, 22, 1, "America/New_York"), True), "weekend": (risk.is_weekend(T), True), "weekend there": (risk.is_weekend(T, "America/New_York"), False), "holiday": (risk.is_holiday(T, ["2024-03-02"]), True), "dormant": (risk.is_dormant(D("2024-01-01"), 30, T), True), "z": (F.round(risk.deviation(L(2500.0), L(150.0), L(75.0)), 2), 31.33),
        "weighted": (F.round(risk.weighted_score([L(25.0), L(60.0), L(40.0), L(15.0)], [0.25, 0.3, 0.25, 0.2]), 2), 37.25), "level": (risk.risk_level(L(36.75)), "medium"), "normal": (risk.normalize_score(L(750.0), 0, 1000), 75.0), "leading": (risk.combine({"a": (L(10.0), 0.5), "b": (L(90.0), 0.5)})["leading"], "b"),
    }


def test_rules(spark):
    wrong = {}
    for name, (column, want) in rules().items():
        got = one(spark, column)
        if not (got == pytest.approx(want) if isinstance(want, float) else got == want):
            wrong[name] = (got, want)
    assert not wrong


@pytest.mark.parametrize("method,want", [("highest_apr_first", [("b", 100.0), ("a", 50.0), ("c", 0.0)]), ("lowest_balance", [("c", 30.0), ("b", 100.0), ("a", 20.0)]), ("fifo", [("a", 150.0), ("c", 0.0), ("b", 0.0)]), ("proportional", [("a", 200 * 150 / 330), ("b", 100 * 150 / 330), ("c", 30 * 150 / 330)])])
def test_payment_allocation(spark, method, want):
    df = spark.createDataFrame([(150.0, [("a", 200.0, 0.1, 1), ("b", 100.0, 0.2, 3), ("c", 30.0, 0.05, 2)])], "p double, b array<struct<id:string,balance:double,apr:double,opened:int>>")
    got = df.select(finance.allocate_payment(F.col("p"), F.col("b"), method).alias("x")).first()["x"]
    assert [(r["id"], pytest.approx(r["paid"])) for r in got] == want


def test_payoff_adds_up(spark):
    paid = one(spark, finance.payoff_interest(F.lit(5000.0), F.lit(0.18), F.lit(150.0)))
    balance, interest = 5000.0, 0.0
    while balance > 0:
        i = balance * 0.015
        interest, balance = interest + i, balance + i - 150
    assert paid == pytest.approx(interest, rel=0.01)


def test_records(spark):
    df = spark.createDataFrame([((1, ("x", None)), "k")], "r struct<a:int,b:struct<c:string,d:string>>, s string")
    r = F.col("r")
    row = df.select(records.put(r, "b.d", "new").alias("p"), records.get_or(r, "b.d", "none").alias("g"), records.remove(r, "b.c").alias("q"), records.rename(r, "a", "z").alias("n"), records.coerce(r, "a string, b struct<c:int>").alias("c")).first()
    assert row.p.b.d == "new" and row.g == "none" and "c" not in row.q.b.asDict() and row.n.z == 1 and row.c.a == "1"
    assert records.has_field(df.schema["r"].dataType, "b.c") and not records.has_field(df.schema["r"].dataType, "b.x")
    flat = records.flatten(df)
    assert flat.columns == ["r_a", "r_b_c", "r_b_d", "s"]
    assert records.unflatten(flat).schema["r"].dataType.names == ["a", "b_c", "b_d"]
    assert records.map_leaves(df, F.upper).first().r.b.c == "X"
    two = spark.createDataFrame([((1, ("x",)), ((None, ("y",), 5)))], "a struct<n:int,m:struct<c:string>>, b struct<n:int,m:struct<c:string>,o:int>")
    merged = two.select(records.merge_deep(F.col("a"), F.col("b"), two.schema["a"].dataType, two.schema["b"].dataType).alias("x")).first().x
    assert (merged.n, merged.m.c, merged.o) == (1, "y", 5)


def test_names(spark):
    assert one(spark, names.function("startsWith")(F.lit("abc"), "a")) is True
    assert one(spark, names.function("calculate_daily_interest")(F.lit(365.0), F.lit(1.0))) == 1.0
    assert one(spark, names.function("array_take")(F.array(F.lit(1), F.lit(2)), 1)) == [1]
    assert one(spark, names.function("initcap")(F.lit("ab cd"))) == "Ab Cd"
    names.register("my_own_function", lambda c: c + 1)
    assert one(spark, names.function("my_own_function")(F.lit(1))) == 2
    with pytest.raises(KeyError):
        names.function("no_such_function")
    with pytest.raises(ValueError):
        names.register("upper", F.upper)
