"""Whole pipelines of several operators, and tools."""

import pandas as pd
from pyspark.sql import functions as F

from tidewright.functions import domain as dm
from tidewright.operators import decide as d
from tidewright.operators import joins, rows, services, state, tools, windows
from tidewright.operators.sql import match_rows, numbered, sql
from tidewright.plans.pipeline import Pipeline
from tidewright.queries.registry import Tables, query

_HOUR = "time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')"
_METRICS = f"""m AS (SELECT {_HOUR} AS window_start, COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS unique_users, COUNT(*) FILTER (event_type = 'view') AS views, COUNT(*) FILTER (event_type = 'purchase') AS purchases, COUNT(*) FILTER (event_type = 'error') AS errors, ROUND(COALESCE(SUM(value) FILTER (event_type = 'purchase'), 0), 4) AS revenue FROM events GROUP BY 1)"""


def _metrics(t: Tables):
    kind, value = F.col("event_type"), F.col("value")
    found = windows.tumbling(t.events, "ts", "1 hour", [
        F.count("*").alias("total_events"), F.countDistinct("user_id").alias("unique_users"), windows.count_if(kind == "view").alias("views"), windows.count_if(kind == "purchase").alias("purchases"),
        windows.count_if(kind == "error").alias("errors"), F.round(F.coalesce(windows.sum_if(value, kind == "purchase"), F.lit(0.0)), 4).alias("revenue"),
    ])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


@query(f"""WITH {_METRICS} SELECT window_start, total_events, unique_users, errors, ROUND(errors * 1000.0 / total_events, 6) AS error_rate, ROUND(CASE WHEN purchases > 0 THEN revenue / purchases ELSE 0 END, 6) AS avg_purchase,
CASE WHEN errors * 1000.0 / total_events >= 400 THEN 'critical' WHEN errors * 1000.0 / total_events BETWEEN 250 AND 399.999 THEN 'warning' ELSE 'ok' END AS level, errors * 1000.0 / total_events >= 250 OR total_events < 8 AS alert FROM m""")
def app_event_aggregator(t: Tables):
    m = _metrics(t).withColumn("rate", F.col("errors") * 1000.0 / F.col("total_events"))
    table = d.DecisionTable([d.Row({"rate": d.at_least(400)}, {"level": F.lit("critical")}), d.Row({"rate": d.span(250, 399.999)}, {"level": F.lit("warning")}), d.Row({}, {"level": F.lit("ok")})], {"level": "string"}, "error_rate_alerts")
    judged = table.apply(m)
    mean = F.when(F.col("purchases") > 0, F.col("revenue") / F.col("purchases")).otherwise(0.0)
    return judged.select("window_start", "total_events", "unique_users", "errors", F.round("rate", 6).alias("error_rate"), F.round(mean, 6).alias("avg_purchase"), "level", ((F.col("rate") >= 250) | (F.col("total_events") < 8)).alias("alert"))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events)
SELECT 'type' AS dimension, event_type AS name, w AS window_start, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM e GROUP BY 2, 3 UNION ALL SELECT 'group', CAST(user_id % 4 AS VARCHAR), w, COUNT(*), COUNT(DISTINCT user_id) FROM e GROUP BY 2, 3""")
def app_multi_dimension(t: Tables):
    def by(name, key):
        def step(df):
            agg = [F.count("*").alias("n"), F.countDistinct("user_id").alias("users")]
            return windows.tumbling(df.withColumn("name", key), "ts", "6 hours", agg, ["name"]).select(F.lit(name).alias("dimension"), "name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "users")

        return step

    return rows.parallel(t.events, {"type": by("type", F.col("event_type")), "group": by("group", (F.col("user_id") % 4).cast("string"))})


@query("""WITH v AS (SELECT event_id, user_id, event_type, value, COUNT(*) OVER w AS n1, SUM(value) OVER w AS s1, AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean
FROM (SELECT *, CAST(FLOOR(epoch(ts)) AS BIGINT) AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY e RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN n1 >= 4 THEN 30 ELSE 0 END + CASE WHEN n1 >= 2 THEN 15 ELSE 0 END + CASE WHEN s1 >= 150 THEN 25 ELSE 0 END + CASE WHEN value >= 90 AND event_type = 'purchase' THEN 35 ELSE 0 END + CASE WHEN value > 3 * mean THEN 20 ELSE 0 END AS points FROM v)
SELECT event_id, CAST(LEAST(points, 100) AS INTEGER) AS score, CASE WHEN points >= 70 THEN 'block' WHEN points >= 40 THEN 'review' ELSE 'pass' END AS decision FROM p""")
def app_fraud_scoring(t: Tables):
    from pyspark.sql import Window

    w = windows.within(["user_id"], "ts", 43200)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t.events.withColumns({"n1": F.count("*").over(w), "s1": F.sum("value").over(w), "mean": F.avg("value").over(before)}).withColumn("far", F.col("value") > 3 * F.col("mean"))
    table = d.DecisionTable(
        [
            d.Row({"n1": d.at_least(4)}, {"rule": F.lit("high_velocity"), "points": F.lit(30)}),
            d.Row({"n1": d.at_least(2)}, {"rule": F.lit("medium_velocity"), "points": F.lit(15)}),
            d.Row({"s1": d.at_least(150)}, {"rule": F.lit("high_amount"), "points": F.lit(25)}),
            d.Row({"value": d.at_least(90), "event_type": d.exact("purchase")}, {"rule": F.lit("large_purchase"), "points": F.lit(35)}),
            d.Row({"far": d.exact(True)}, {"rule": F.lit("unusual"), "points": F.lit(20)}),
        ],
        {"rule": "string", "points": "int"},
        "fraud_rules",
    )
    scored = e.withColumn("points", F.aggregate(F.transform(table.hits(), lambda h: h["points"]), F.lit(0), lambda a, x: a + x))
    return scored.select("event_id", F.least("points", F.lit(100)).alias("score"), F.when(F.col("points") >= 70, "block").when(F.col("points") >= 40, "review").otherwise("pass").alias("decision"))


@query("""WITH i AS (SELECT l_orderkey, COUNT(*) AS items, SUM(l_quantity) AS quantity, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem GROUP BY 1)
SELECT o_orderkey, COALESCE(items, 0) AS items, COALESCE(net, 0) AS net, c_mktsegment, CASE WHEN items IS NULL THEN 'rejected' WHEN net > 200000 THEN 'manual' WHEN o_orderpriority = '1-URGENT' THEN 'express' ELSE 'standard' END AS lane FROM orders LEFT JOIN i ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def app_order_processing(t: Tables):
    def totals(l):
        return l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"))

    def lane(df):
        return rows.split(df, [("rejected", F.col("items").isNull()), ("manual", F.col("net") > 200000), ("express", F.col("o_orderpriority") == "1-URGENT")], "standard", "lane")

    p = Pipeline("orders").receive("orders", t.orders).receive("items", t.lineitem).receive("customers", t.customer.withColumnRenamed("c_custkey", "o_custkey"))
    p.apply("items", totals, "totals").apply(("orders", "totals"), lambda o, i: o.join(i, "o_orderkey", "left"), "priced")
    p.apply(("priced", "customers"), lambda o, c: joins.enrich(o, c, ["o_custkey"], ["c_mktsegment"]), "enriched").apply("enriched", lane, "routed").emit("routed", "fulfilment")
    return p.output("fulfilment").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("net", F.lit(0.0)).alias("net"), "c_mktsegment", "lane")


@query("""WITH s AS (SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS spent FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'declined' WHEN c_acctbal >= 5000 AND COALESCE(spent, 0) >= 100000 THEN 'approved' WHEN c_acctbal >= 1000 THEN 'review' ELSE 'declined' END AS decision,
CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_acctbal >= 5000 AND COALESCE(spent, 0) >= 100000 THEN 'good standing' WHEN c_acctbal >= 1000 THEN 'thin file' ELSE 'low balance' END AS reason FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def app_credit_decision(t: Tables):
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    table = d.DecisionTable(
        [
            d.Row({"c_acctbal": d.less(0)}, {"decision": F.lit("declined"), "reason": F.lit("negative balance")}),
            d.Row({"c_acctbal": d.at_least(5000), "spent": d.at_least(100000)}, {"decision": F.lit("approved"), "reason": F.lit("good standing")}),
            d.Row({"c_acctbal": d.at_least(1000)}, {"decision": F.lit("review"), "reason": F.lit("thin file")}),
            d.Row({}, {"decision": F.lit("declined"), "reason": F.lit("low balance")}),
        ],
        {"decision": "string", "reason": "string"},
    )
    return table.apply(t.customer.join(spent, "c_custkey", "left")).select("c_custkey", "decision", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'matched' END AS status FROM orders""")
def app_reconciliation(t: Tables):
    settled = t.orders.where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("amount"))
    return sql(
        """SELECT t.o_orderkey, CASE WHEN t.o_totalprice = s.amount THEN 'matched' WHEN s.amount IS NULL THEN 'missing' ELSE 'mismatch' END AS status
        FROM transactions t LEFT JOIN settlements s ON t.o_orderkey = s.o_orderkey""",
        transactions=t.orders, settlements=settled,
    )


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
nxt AS (SELECT a.user_id, a.r, MIN(b.r) AS stop FROM s a JOIN s b ON a.user_id = b.user_id AND b.r > a.r AND b.event_type NOT IN ('view', 'click') WHERE a.event_type = 'view' GROUP BY 1, 2),
c AS (SELECT n.user_id, n.r, n.stop, s.event_type AS final FROM nxt n JOIN s ON s.user_id = n.user_id AND s.r = n.stop WHERE s.event_type = 'purchase'),
f AS (SELECT user_id, MIN(r) AS r, stop FROM c GROUP BY user_id, stop)
SELECT f.user_id, a.event_id AS journey_start, b.event_id AS conversion, f.stop - f.r - 1 AS touchpoints FROM f JOIN s a ON a.user_id = f.user_id AND a.r = f.r JOIN s b ON b.user_id = f.user_id AND b.r = f.stop""")
def sql_user_journeys(t: Tables):
    kind = F.col("event_type")
    found = match_rows(t.events, ["user_id"], ["ts", "event_id"], {"A": kind == "view", "B": kind == "click", "C": kind == "purchase"}, "A[AB]*C")
    places = numbered(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "row", "event_id")
    first = places.select("user_id", F.col("row").cast("bigint").alias("first_row"), F.col("event_id").alias("journey_start"))
    last = places.select("user_id", F.col("row").cast("bigint").alias("last_row"), F.col("event_id").alias("conversion"))
    return found.join(first, ["user_id", "first_row"]).join(last, ["user_id", "last_row"]).select("user_id", "journey_start", "conversion", (F.col("last_row") - F.col("first_row") - 1).alias("touchpoints"))


@query("""SELECT event_id, user_id, 'replayed' AS event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10' AND value > 40""")
def stream_replay(t: Tables):
    return tools.replay(t.events, F.col("value") > 40, {"event_type": F.lit("replayed")}, "ts", "2024-01-05", "2024-01-10").select("event_id", "user_id", "event_type")


@query("""SELECT event_type, CAST(CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 90 THEN 90 END AS DOUBLE) AS le, COUNT(*) AS n FROM events GROUP BY 1, 2""")
def metrics_histogram(t: Tables):
    return tools.histogram(t.events, "value", [10, 50, 90], ["event_type"])


@query(f"""SELECT {_HOUR} AS window_start, ROUND(COUNT(*) / 3600.0, 10) AS rate FROM events GROUP BY 1""")
def metrics_rate(t: Tables):
    return tools.rate(t.events, "ts", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("rate", 10).alias("rate"))


@query("""SELECT user_id, array_to_string(list_slice(list(value ORDER BY value DESC), 1, 3), ',') AS top FROM (SELECT user_id, CAST(FLOOR(value) AS BIGINT) AS value FROM events) GROUP BY 1""")
def agg_topk_values(t: Tables):
    top = windows.top_values(t.events, ["user_id"], F.floor("value"), 3)
    return top.select("user_id", F.concat_ws(",", F.col("top").cast("array<string>")).alias("top"))


@query("""SELECT event_id, CASE WHEN ts >= (SELECT MIN(ts) FROM events WHERE value > 99) THEN 'after' ELSE 'before' END AS era FROM events""")
def dt_marker_cells(t: Tables):
    m = state.marker_at_signal(t.events, "peak", "ts", F.col("value") > 99)
    marked = state.with_markers(t.events, "ts", m, ["peak"])
    table = d.DecisionTable([d.Row({"fired_peak": d.exact(True)}, {"era": F.lit("after")}), d.Row({}, {"era": F.lit("before")})], {"era": "string"})
    return table.apply(marked).select("event_id", "era")


@query("""SELECT c_custkey, ROUND(c_acctbal * 2 + 1, 6) AS score FROM customer""")
def call_service(t: Tables):
    def model(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return t.customer.select("c_custkey", F.round(services.service(model, "double")(F.col("c_acctbal")), 6).alias("score"))


def _letter(i: int) -> str:
    """SQL of the i-th letter from the bits of x (18, longitude) and y (17, latitude)."""
    bits = (f"(({'x' if k % 2 == 0 else 'y'} >> {(18 if k % 2 == 0 else 17) - 1 - k // 2}) & 1) * {1 << (4 - k + 5 * i)}" for k in range(5 * i, 5 * i + 5))
    return f"substr('{dm.GEOHASH}', CAST(1 + {' + '.join(bits)} AS BIGINT), 1)"


@query(f"""SELECT s_suppkey, {' || '.join(map(_letter, range(7)))} AS geohash FROM (SELECT s_suppkey, CAST(floor((s_suppkey * 7 % 360 - 180 + 0.456 + 180) / 360 * 262144) AS BIGINT) AS x, CAST(floor((s_suppkey % 180 - 90 + 0.123 + 90) / 180 * 131072) AS BIGINT) AS y FROM supplier)""")
def domain_geohash(t: Tables):
    """Geohashes of suppliers' made-up places."""
    lat, lon = (F.col("s_suppkey") % 180 - 90).cast("double") + 0.123, (F.col("s_suppkey") * 7 % 360 - 180).cast("double") + 0.456
    return t.supplier.select("s_suppkey", dm.geohash(lat, lon, 7).alias("geohash"))
