"""Masking of personal data in records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns whose presence masks a whole value.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\b\d{3}[-.]\d{3}[-.]\d{4}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def has_personal_data(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in PATTERNS.values())), F.lit(False))


def kind_of(c: Column) -> Column:
    """The first kind found; null without any."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def mask_records(df: DataFrame, names: Sequence[str], star: str = "***") -> DataFrame:
    """Masks string columns whose name is in one of `names` or holds one (letters in either case), and values that look like personal data."""
    wanted = [n.lower() for n in names]
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if any(f.name.lower() in n or n in f.name.lower() for n in wanted):
            c = F.when(c.isNotNull(), F.lit(star))
        elif f.dataType.simpleString() == "string":
            c = F.when(has_personal_data(c), F.lit(star)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def encrypt(c: Column, key: Column) -> Column:
    """Reversible and the same for equal values (AES in ECB mode, base 64); a stand-in for format-preserving encryption, not a substitute."""
    return F.base64(F.aes_encrypt(c, key, F.lit("ECB"), F.lit("PKCS")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("ECB"), F.lit("PKCS")).cast("string")
