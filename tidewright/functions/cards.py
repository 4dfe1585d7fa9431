"""Payment cards: numbers, networks, expiry, and what may be logged. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading digits and lengths of the card networks, in the order in which they are tried.
NETWORKS = (
    ("visa", r"^4(\d{12}|\d{15}|\d{18})$"),
    ("mastercard", r"^(5[1-5]\d{14}|(222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)\d{12})$"),
    ("amex", r"^3[47]\d{13}$"),
    ("discover", r"^(6011\d{12,15}|64[4-9]\d{13,16}|65\d{14,17})$"),
    ("diners", r"^(30[0-5]\d{11,16}|3[68]\d{12,17})$"),
    ("jcb", r"^35(2[89]|[3-8]\d)\d{12,15}$"),
    ("unionpay", r"^62\d{14,17}$"),
)
#: What looks like a card number in a text.
PAN = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{1,7}\b"


def digits(pan: Column) -> Column:
    """Without blanks and dashes."""
    return F.regexp_replace(pan, "[ -]", "")


def pan_length(pan: Column) -> Column:
    return F.length(digits(pan))


def luhn_validate(pan: Column) -> Column:
    """Digits only (blanks and dashes aside) and the check digit is right; false for a null."""
    return F.coalesce(F.call_function("luhn_check", digits(pan)), F.lit(False))


def luhn_checksum(body: Column) -> Column:
    """The digit that makes the number valid when it is put at its end."""
    numbers = F.transform(F.split(F.reverse(digits(body)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + d)
    return (10 - total % 10) % 10


def mask_pan_custom(pan: Column, show_first: int, show_last: int, sign: str = "*") -> Column:
    plain = digits(pan)
    hidden = F.greatest(F.length(plain) - show_first - show_last, F.lit(0))
    return F.concat(F.left(plain, F.lit(show_first)), F.repeat(F.lit(sign), hidden), F.right(plain, F.lit(show_last)))


def mask_pan(pan: Column) -> Column:
    return mask_pan_custom(pan, 6, 4)


def extract_bin(pan: Column, size: int = 6) -> Column:
    return F.left(digits(pan), F.lit(size))


def extract_last_four(pan: Column) -> Column:
    return F.right(digits(pan), F.lit(4))


def identify_card_network(pan: Column) -> Column:
    """Name of the network, null if it is none of these."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(NETWORKS):
        out = F.when(digits(pan).rlike(pattern), name).otherwise(out)
    return out


def is_network(pan: Column, name: str) -> Column:
    return F.coalesce(digits(pan).rlike(dict(NETWORKS)[name]), F.lit(False))


def parse_expiry(text: Column) -> Column:
    """MM/YY or MMYY to the last day of that month; null for anything else."""
    m, y = F.regexp_extract(text, r"^(\d{2})/?(\d{2})$", 1), F.regexp_extract(text, r"^(\d{2})/?(\d{2})$", 2)
    month = m.try_cast("int")
    good = month.between(1, 12) & (y != "")
    return F.when(good, F.last_day(F.make_date(2000 + y.try_cast("int"), month, F.lit(1))))


def is_expired(expiry: Column, on: Column) -> Column:
    return F.last_day(expiry) < F.to_date(on)


def is_expiring_soon(expiry: Column, days: int, on: Column) -> Column:
    left = F.datediff(F.last_day(expiry), F.to_date(on))
    return (left >= 0) & (left <= days)


def months_until_expiry(expiry: Column, on: Column) -> Column:
    return F.floor(F.months_between(F.last_day(expiry), F.to_date(on))).cast("int")


def format_expiry(expiry: Column) -> Column:
    return F.date_format(expiry, "MM/yy")


def is_safe_to_log(message: Column) -> Column:
    """No card number in it."""
    return ~F.coalesce(message.rlike(PAN), F.lit(False))


def sanitize_for_logging(message: Column) -> Column:
    return F.regexp_replace(message, PAN, "[card]")


def hash_pan(pan: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), digits(pan)), 256)


def tokenize_pan(pan: Column, salt: str) -> Column:
    """A number of the same length that keeps the first six and last four digits; one way, the same for equal numbers."""
    plain = digits(pan)
    middle = F.greatest(F.length(plain) - 10, F.lit(0))
    made = F.lpad(F.pmod(F.xxhash64(F.concat(F.lit(salt), plain)), F.lit(10**15)).cast("string"), 15, "0")
    return F.concat(F.left(plain, F.lit(6)), F.left(made, middle), F.right(plain, F.lit(4)))
