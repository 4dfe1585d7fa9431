"""Schemas and pipelines."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import rows
from tidewright.plans.pipeline import Pipeline
from tidewright.plans.schema import Field, Schema, divide, entries


def card(version="1.2.0"):
    return Schema(
        "card",
        [Field("id", "uuid", required=True), Field("amount", "decimal", precision=(12, 2), low=0), Field("currency", "string", length=3, default="USD"), Field("month", "integer", low=1, high=12), Field("kind", "string", values=("a", "b"))],
        version,
        key=["id"],
        computed={"double": F.col("amount") * 2},
        constraints=[rows.Check(F.col("amount") < 1000, "too much")],
    )


def test_conform_and_check(spark):
    uid = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(uid, "12.345", None, "3", "a"), (None, "-1", "EURO", "13", "z"), ("x", "zz", "EUR", "0", None), (uid, "5000", "EUR", "1", "b")], "id string, amount string, currency string, month string, kind string")
    s = card()
    got = s.conform(df)
    assert dict(got.dtypes)["amount"] == "decimal(12,2)" and dict(got.dtypes)["month"] == "bigint"
    found = [r.m for r in got.select(rows.messages(s.checks()).alias("m")).collect()]
    assert found[0] == []
    assert found[1] == ["id is required", "amount is below 0", "currency has a wrong length", "month is above 12", "kind is not an allowed value"]
    assert found[2] == ["id does not match", "month is below 1", "too much"]
    assert found[3] == ["too much"]
    assert got.first()["currency"] == "USD" and float(got.first()["double"]) == 24.70


def test_versions(spark):
    s = card("1.2.0")
    assert s.compatible("1.1.9") and not s.compatible("1.3.0") and not s.compatible("2.0.0")
    assert s.compatible("1.3.0", "forward") and s.compatible("1.0.0", "full") and not s.compatible("1.2.1", "none")
    with pytest.raises(ValueError):
        s.migrate(spark.range(1), "1.2.0", {})
    moved = s.migrate(spark.createDataFrame([("x", 3)], "old_id string, month int"), "1.1.0", {"id": "old_id"})
    assert tuple(moved.first()) == ("x", None, None, 3, None)


@pytest.mark.parametrize("bad", [dict(fields=[Field("a", "string"), Field("a", "string")]), dict(fields=[Field("a", "string")], version="1.0"), dict(fields=[Field("a", "string")], key=["b"])])
def test_bad_schemas(bad):
    with pytest.raises(ValueError):
        Schema("s", **bad)


def test_entries_and_division(spark):
    e = entries(spark, [("a", 1), ("b", 2)], "code string, n int", ["b"])
    assert [r.deprecated for r in e.orderBy("code").collect()] == [False, True]
    assert spark.range(1).select(divide(F.lit(1).cast("decimal(10,2)"), F.lit(3), 2).alias("x"), divide(F.lit(1), F.lit(0), 2).alias("y")).first()["y"] is None


def test_pipeline(spark):
    p = Pipeline("orders").receive("in", spark.range(10)).apply("in", lambda d: rows.validate(d, [rows.Check(F.col("id") > 3, "small")]), into=("good", "bad"))
    p.apply(("good", "in"), lambda a, b: a.join(b, "id"), into="joined").emit("joined", "out").emit("bad", "rejects")
    assert p.output("out").count() == 6 and p.output("rejects").count() == 4
    assert {"from": ["good", "in"], "step": "<lambda>", "to": "joined"} in p.graph()["edges"]
    for wrong in (lambda: p.receive("in", spark.range(1)), lambda: p.apply("nope", lambda d: d, "x"), lambda: p.emit("nope", "t"), lambda: p.apply("in", lambda d: (d, d), ("a", "b", "c"))):
        with pytest.raises(ValueError):
            wrong()
