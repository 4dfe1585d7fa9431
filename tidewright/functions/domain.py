"""Places and the business calendar, as Column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Letters of the geohash alphabet.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, letters: int = 6) -> Column:
    """Geohash by interleaving the bits of longitude and latitude."""
    bits = 5 * letters
    east, north = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << east)), F.lit((1 << east) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * (1 << north)), F.lit((1 << north) - 1)).cast("bigint")
    out = []
    for i in range(letters):
        value = F.lit(0)
        for k in range(5 * i, 5 * i + 5):  # even places are longitude, from the highest bit down
            source, width = (x, east) if k % 2 == 0 else (y, north)
            value = value * 2 + F.shiftright(source, width - 1 - k // 2).bitwiseAND(F.lit(1).cast("bigint"))
        out.append(F.substr(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


# -- business calendar ----------------------------------------------------------
def calendar(spark, start: str, end: str, holidays: list[str] = ()) -> DataFrame:
    """One row a day, with a dense index of business days: `day`, `is_business`, `nth` (business days up to and with it)."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS day")
    free = F.col("day").isin([F.to_date(F.lit(h)) for h in holidays]) if holidays else F.lit(False)
    open_ = (F.weekday("day") < 5) & ~free
    # a calendar has a few thousand days: one ordered window over it is small
    return days.withColumn("is_business", open_).withColumn("nth", F.sum(F.col("is_business").cast("int")).over(Window.orderBy("day")))


def add_business_days(df: DataFrame, days: DataFrame, column: str, n: int, into: str) -> DataFrame:
    """The n-th business day after `column`, by two joins with the calendar (a few thousand rows, which Spark sees and broadcasts)."""
    here = days.select(F.col("day").alias("_d"), F.col("nth").alias("_n"))
    there = days.where("is_business").select(F.col("nth").alias("_m"), F.col("day").alias(into))
    out = df.join(here, F.to_date(column) == F.col("_d"), "left").join(there, F.col("_n") + n == F.col("_m"), "left")
    return out.drop("_d", "_n", "_m")


def business_days_between(df: DataFrame, days: DataFrame, start: str, end: str, into: str) -> DataFrame:
    """Business days after `start` up to and with `end`."""
    a = days.select(F.col("day").alias("_a"), F.col("nth").alias("_na"))
    b = days.select(F.col("day").alias("_b"), F.col("nth").alias("_nb"))
    out = df.join(a, F.to_date(start) == F.col("_a"), "left").join(b, F.to_date(end) == F.col("_b"), "left")
    return out.withColumn(into, F.col("_nb") - F.col("_na")).drop("_a", "_na", "_b", "_nb")
