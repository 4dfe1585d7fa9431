"""Interest, fees, payments, utilization, currencies. All are Column expressions; rates are shares (0.18 is 18 %)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies without decimal places.
ZERO_DECIMALS = ("JPY", "KRW", "VND", "CLP", "ISK")
#: Signs of currencies.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "KRW": "₩", "VND": "₫", "INR": "₹", "CHF": "CHF", "CAD": "$", "AUD": "$", "CLP": "$", "ISK": "kr"}
#: Utilization tiers, each up to its percentage.
TIERS = ((10, "excellent"), (30, "good"), (50, "fair"), (75, "high"), (100, "critical"))


# -- interest -------------------------------------------------------------------
def daily_interest(principal: Column, apr: Column) -> Column:
    return principal * apr / 365


def monthly_interest(principal: Column, apr: Column) -> Column:
    return principal * apr / 12


def interest_for_period(principal: Column, apr: Column, days: Column) -> Column:
    return principal * apr / 365 * days


def apr_from_daily(rate: Column) -> Column:
    return rate * 365


def daily_from_apr(apr: Column) -> Column:
    return apr / 365


def effective_apr(apr: Column, periods: int) -> Column:
    return F.pow(1 + apr / periods, F.lit(periods)) - 1


# -- fees -----------------------------------------------------------------------
def late_fee(days: Column, tiers: list[tuple[int, int | None, float]], base: float = 0.0, most: float | None = None, waived: Column | None = None) -> Column:
    """Base and tier fee by days overdue ([least, most] days, an open end is None), capped; nothing when not overdue or waived."""
    fee = F.lit(0.0)
    for least, last, amount in reversed(tiers):
        inside = (days >= least) if last is None else days.between(least, last)
        fee = F.when(inside, F.lit(float(amount))).otherwise(fee)
    total = fee + base
    total = total if most is None else F.least(total, F.lit(float(most)))
    free = days <= 0 if waived is None else (days <= 0) | F.coalesce(waived, F.lit(False))
    return F.when(free, 0.0).otherwise(total)


def overlimit_fee(balance: Column, limit: Column, fee: float) -> Column:
    return F.when(balance > limit, F.lit(float(fee))).otherwise(0.0)


def cash_advance_fee(amount: Column, share: float, least: float, most: float) -> Column:
    return F.least(F.greatest(amount * share, F.lit(float(least))), F.lit(float(most)))


def foreign_transaction_fee(amount: Column, share: float) -> Column:
    return amount * share


def balance_transfer_fee(amount: Column, share: float, least: float) -> Column:
    return F.greatest(amount * share, F.lit(float(least)))


def annual_fee(fee: Column, months: Column) -> Column:
    """Prorated by months."""
    return fee * F.least(F.greatest(months, F.lit(0)), F.lit(12)) / 12


# -- payments -------------------------------------------------------------------
def minimum_payment(balance: Column, share: float, least: float, interest: Column, fees: Column) -> Column:
    """The greater of a share and a least amount, with interest and fees, and never more than is owed."""
    owed = balance + interest + fees
    return F.when(owed <= 0, 0.0).otherwise(F.least(F.greatest(balance * share, F.lit(float(least))) + interest + fees, owed))


def payoff_months(balance: Column, apr: Column, payment: Column) -> Column:
    """Months until a fixed payment has paid all; null if it never does."""
    r = apr / 12
    plain = F.ceil(balance / payment)
    with_interest = F.ceil(-F.log1p(-balance * r / payment) / F.log1p(r))
    return F.when(payment <= balance * r, F.lit(None)).when(r == 0, plain).otherwise(with_interest).cast("int")


def payoff_interest(balance: Column, apr: Column, payment: Column) -> Column:
    """Interest over those months: the annuity's payments less the balance; null if it is never paid."""
    r = apr / 12
    exact = F.when(payment <= balance * r, F.lit(None)).when(r == 0, balance / payment).otherwise(-F.log1p(-balance * r / payment) / F.log1p(r))
    return exact * payment - balance


def statement_balance(previous: Column, payments: Column, purchases: Column, interest: Column, fees: Column) -> Column:
    return previous - payments + purchases + interest + fees


def allocate_payment(payment: Column, balances: Column, method: str = "highest_apr_first") -> Column:
    """Splits a payment over an array of (id, balance, apr, opened); gives (id, paid) in the order of paying."""
    if method == "proportional":
        total = F.aggregate(balances, F.lit(0.0), lambda s, b: s + b["balance"])
        share = F.least(F.coalesce(F.try_divide(payment, total), F.lit(0.0)), F.lit(1.0))
        return F.transform(balances, lambda b: F.struct(b["id"].alias("id"), (b["balance"] * share).alias("paid")))
    keys = {"highest_apr_first": lambda b: -b["apr"], "lowest_balance": lambda b: b["balance"], "fifo": lambda b: b["opened"]}
    ordered = F.array_sort(F.transform(balances, lambda b: F.struct(keys[method](b).alias("k"), b["id"].alias("id"), b["balance"].alias("balance"))))

    def pay(state: Column, b: Column) -> Column:
        paid = F.least(state["left"], b["balance"])
        return F.struct((state["left"] - paid).alias("left"), F.concat(state["out"], F.array(F.struct(b["id"].alias("id"), paid.alias("paid")))).alias("out"))

    start = F.struct(payment.cast("double").alias("left"), F.filter(F.transform(ordered, lambda b: F.struct(b["id"].alias("id"), b["balance"].alias("paid"))), lambda _: F.lit(False)).alias("out"))
    return F.aggregate(ordered, start, pay)["out"]


# -- utilization ----------------------------------------------------------------
def utilization(balance: Column, limit: Column) -> Column:
    return F.try_divide(balance * 100, limit)


def available_credit(limit: Column, balance: Column, pending: Column) -> Column:
    return limit - balance - pending


def is_overlimit(balance: Column, limit: Column) -> Column:
    return F.coalesce(balance > limit, F.lit(False))


def utilization_tier(percent: Column) -> Column:
    out = F.lit("overlimit")
    for most, name in reversed(TIERS):
        out = F.when(percent <= most, name).otherwise(out)
    return F.when(percent.isNotNull(), out)


def utilization_target(limit: Column) -> Column:
    return limit * 0.3


# -- currencies -----------------------------------------------------------------
def decimal_places(code: Column) -> Column:
    return F.when(code.isin(*ZERO_DECIMALS), 0).when(code.isNotNull(), 2)


def is_zero_decimal(code: Column) -> Column:
    return F.coalesce(code.isin(*ZERO_DECIMALS), F.lit(False))


def currency_symbol(code: Column) -> Column:
    """The sign, or the code itself."""
    signs = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))
    return F.coalesce(F.try_element_at(signs, code), code)


def round_to_currency(amount: Column, code: Column) -> Column:
    return F.when(is_zero_decimal(code), F.round(amount, 0)).otherwise(F.round(amount, 2))


def is_valid_amount(amount: Column, code: Column) -> Column:
    """Not negative, with no more places than the currency has."""
    return F.coalesce((amount >= 0) & (round_to_currency(amount, code) == amount), F.lit(False))


def minor_units(amount: Column, code: Column) -> Column:
    return F.round(amount * F.when(is_zero_decimal(code), 1).otherwise(100), 0).cast("bigint")


def from_minor_units(units: Column, code: Column) -> Column:
    return units / F.when(is_zero_decimal(code), 1).otherwise(100)


def format_currency(amount: Column, code: Column) -> Column:
    return F.concat(currency_symbol(code), F.when(is_zero_decimal(code), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)))


# -- liability ------------------------------------------------------------------
def debit_liability(amount: Column, days_to_report: Column) -> Column:
    """At most 50 when reported within 2 days, at most 500 within 60, else all of it."""
    return F.when(days_to_report <= 2, F.least(amount, F.lit(50.0))).when(days_to_report <= 60, F.least(amount, F.lit(500.0))).otherwise(amount)


def within_dispute_window(day: Column, on: Column, days: int) -> Column:
    return F.coalesce(F.datediff(F.to_date(on), F.to_date(day)).between(0, days), F.lit(False))


def chargeback_deadline(day: Column, days: int) -> Column:
    return F.date_add(F.to_date(day), days)
