"""Windows, aggregates and analytic functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import windows as op
from tidewright.queries.registry import Tables, query


def _naive(df):
    """Window bounds without a zone, as the event times are."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end") if c in df.columns})


_BUCKET = "time_bucket(INTERVAL {0}, ts, TIMESTAMP '1970-01-01')"


@query(f"SELECT {_BUCKET.format('1 HOUR')} AS window_start, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1")
def tumbling(t: Tables):
    return _naive(op.tumbling(t.events, "ts", "1 hour", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])).drop("window_end")


@query(f"SELECT {_BUCKET.format('1 HOUR')} AS window_start, {_BUCKET.format('1 HOUR')} + INTERVAL 1 HOUR AS window_end, user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 8) AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1, 2, 3")
def tumbling_keyed(t: Tables):
    agg = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 8).alias("mean")]
    return _naive(op.tumbling(t.events.where("event_type = 'purchase'"), "ts", "1 hour", agg, ["user_id"]))


@query("SELECT w AS window_start, event_type, COUNT(*) AS n FROM (SELECT event_type, UNNEST(generate_series(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 2 HOUR)) AS w FROM events) GROUP BY 1, 2")
def sliding(t: Tables):
    return _naive(op.sliding(t.events, "ts", "6 hours", "2 hours", [F.count("*").alias("n")], ["event_type"])).drop("window_end")


@query("""WITH o AS (SELECT *, COALESCE(ts > LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR, FALSE) AS fresh FROM events),
s AS (SELECT *, SUM(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 8 HOUR AS window_end, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def session(t: Tables):
    return _naive(op.session(t.events, "ts", "8 hours", [F.count("*").alias("n")], ["user_id"]))


@query("SELECT user_id, CAST(r // 4 AS BIGINT) AS chunk, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) GROUP BY 1, 2")
def count_window(t: Tables):
    c = op.count_window(t.events, ["user_id"], ["ts", "event_id"], 4, [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return c.withColumn("chunk", F.col("chunk").cast("bigint"))


@query("SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 8) AS mean3 FROM events")
def count_window_sliding(t: Tables):
    return t.events.select("event_id", F.round(F.avg("value").over(op.last_rows(["user_id"], ["ts", "event_id"], 3)), 8).alias("mean3"))


@query("SELECT event_id FROM (SELECT event_id, ts, MAX(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE ts < m - INTERVAL 2 HOUR")
def late_split(t: Tables):
    return op.late_split(t.events, "ts", "event_id", "2 hours", ["event_type"])[1].select("event_id")


@query("""WITH o AS (SELECT *, COALESCE(ts > LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY, FALSE) AS fresh FROM events)
SELECT event_id, CAST(SUM(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM o""")
def sessionize(t: Tables):
    return op.sessions(t.events, ["user_id"], "ts", "1 day", ["event_id"]).select("event_id", "session")


@query("""SELECT user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 8) AS mean, MIN(value) AS low, MAX(value) AS high, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids,
CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS first_id, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS last_id FROM events GROUP BY 1""")
def agg_inline8(t: Tables):
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 8).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.concat_ws(",", op.collect_ordered(F.col("event_id").cast("string"), order)).alias("ids"), op.first_value_by(F.col("event_id"), order).alias("first_id"), op.last_value_by(F.col("event_id"), order).alias("last_id"),
    )


@query("""SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(STDDEV_POP(l_quantity), 6) AS sdp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(VAR_POP(l_quantity), 6) AS vp, MEDIAN(l_quantity) AS med, ROUND(quantile_cont(l_quantity, 0.9), 6) AS p90, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def agg_stats(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sdp"), F.round(F.var_samp(q), 6).alias("vs"), F.round(F.var_pop(q), 6).alias("vp"), F.median(q).alias("med"), F.round(op.percentile(q, 90), 6).alias("p90"), F.countDistinct("l_partkey").alias("parts"))


@query("""SELECT user_id, COUNT(*) FILTER (event_type = 'click') AS clicks, ROUND(SUM(value) FILTER (event_type = 'purchase'), 4) AS spent, ROUND(AVG(value) FILTER (event_type = 'view'), 8) AS seen, MIN(value) FILTER (event_type = 'error') AS low, MAX(value) FILTER (event_type = 'error') AS high FROM events GROUP BY 1""")
def agg_conditional(t: Tables):
    v, k = F.col("value"), F.col("event_type")
    return t.events.groupBy("user_id").agg(op.count_if(k == "click").alias("clicks"), F.round(op.sum_if(v, k == "purchase"), 4).alias("spent"), F.round(op.avg_if(v, k == "view"), 8).alias("seen"), op.min_if(v, k == "error").alias("low"), op.max_if(v, k == "error").alias("high"))


@query("""SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments, array_to_string(list_slice(list(c_custkey ORDER BY c_custkey), 1, 3), ',') AS firsts, string_agg(c_mktsegment, '/' ORDER BY c_mktsegment) AS joined FROM customer GROUP BY 1""")
def agg_collect(t: Tables):
    firsts = op.first_values(t.customer, ["c_nationkey"], F.col("c_custkey"), [F.col("c_custkey")], 3, "firsts")
    whole = t.customer.groupBy("c_nationkey").agg(F.concat_ws("|", F.array_sort(F.collect_set("c_mktsegment"))).alias("segments"), op.string_agg(F.col("c_mktsegment"), "/").alias("joined"))
    return whole.join(firsts.withColumn("firsts", F.concat_ws(",", F.col("firsts").cast("array<string>"))), "c_nationkey")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS newest, arg_min(value, (ts, event_id)) AS oldest FROM events GROUP BY 1""")
def agg_first_last_by(t: Tables):
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(op.latest_by(F.col("value"), order).alias("newest"), op.first_value_by(F.col("value"), order).alias("oldest"))


@query("""SELECT l_shipmode, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, COUNT(*) AS n FROM lineitem GROUP BY 1)""")
def agg_expression_key(t: Tables):
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 2""")
def topk_per_key(t: Tables):
    return op.top_k(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(f"""WITH h AS (SELECT {_BUCKET.format('1 HOUR')} AS h, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY 1) SELECT date_trunc('day', h) AS day, CAST(SUM(n) AS BIGINT) AS n, MAX(n) AS busiest, ROUND(SUM(s), 4) AS total FROM h GROUP BY 1""")
def rollup_hourly_daily(t: Tables):
    hours = op.tumbling(t.events, "ts", "1 hour", [F.count("*").alias("n"), F.sum("value").alias("s")])
    return _naive(op.tumbling(hours, "window_start", "1 day", [F.sum("n").alias("d"), F.max("n").alias("busiest"), F.round(F.sum("s"), 4).alias("total")])).select(F.col("window_start").alias("day"), F.col("d").alias("n"), "busiest", "total")


@query("""SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("bigint").alias("g"))


@query("""SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(ROW_NUMBER() OVER w AS INT) AS rn, CAST(RANK() OVER v AS INT) AS rk, CAST(DENSE_RANK() OVER v AS INT) AS dr, LAG(value) OVER w AS prev, LEAD(value, 2, -1.0) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def rank_lag(t: Tables):
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return t.events.select("event_id", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.lag("value").over(w).alias("prev"), F.lead("value", 2, -1.0).over(w).alias("next2"))


@query("""SELECT event_id, ROUND(SUM(value) OVER w, 4) AS total, COUNT(*) OVER w AS n, ROUND(AVG(value) OVER w, 8) AS mean, MIN(value) OVER w AS low, MAX(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(t: Tables):
    w = op.running(["user_id"], ["ts", "event_id"])
    return t.events.select("event_id", F.round(F.sum("value").over(w), 4).alias("total"), F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 8).alias("mean"), F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


@query("""SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CAST(FLOOR(epoch(ts)) AS BIGINT) AS epoch_s FROM events)""")
def range_last_hour(t: Tables):
    return t.events.select("event_id", F.count("*").over(op.within(["user_id"], "ts", 3600)).alias("n"))


@query("""SELECT a.event_id, COUNT(DISTINCT b.event_type) AS kinds FROM (SELECT *, CAST(FLOOR(epoch(ts)) AS BIGINT) AS e FROM events) a JOIN (SELECT *, CAST(FLOOR(epoch(ts)) AS BIGINT) AS e FROM events) b ON a.user_id = b.user_id AND b.e BETWEEN a.e - 86400 AND a.e GROUP BY 1""")
def distinct_last_day(t: Tables):
    return t.events.select("event_id", op.distinct_within("event_type", op.within(["user_id"], "ts", 86400)).cast("bigint").alias("kinds"))


@query("""SELECT o_orderkey, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders""")
def share_of_total(t: Tables):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 8).alias("share"))


@query("""SELECT user_id, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id, event_id FROM events""")
def nth_value(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select("user_id", F.nth_value("event_id", 2).over(w).alias("second_id"), "event_id")


@query("""SELECT COALESCE(c.user_id, v.user_id) AS user_id, c.n AS clicks, v.n AS views, CASE WHEN c.user_id IS NULL THEN 'clicks' WHEN v.user_id IS NULL THEN 'views' ELSE '' END AS missing
FROM (SELECT user_id, COUNT(*) n FROM events WHERE event_type = 'click' AND value > 70 GROUP BY 1) c FULL JOIN (SELECT user_id, COUNT(*) n FROM events WHERE event_type = 'view' AND value > 70 GROUP BY 1) v ON c.user_id = v.user_id""")
def aggregate_partial(t: Tables):
    big = t.events.where("value > 70")
    parts = {"clicks": big.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks")), "views": big.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"))}
    return op.aggregate_with_missing(parts, ["user_id"]).select("user_id", "clicks", "views", F.concat_ws(",", "missing").alias("missing"))


@query("""SELECT event_type FROM events WHERE value > 90 UNION SELECT event_type FROM events WHERE value < 1""")
def union_distinct(t: Tables):
    return t.events.where("value > 90").select("event_type").union(t.events.where("value < 1").select("event_type")).distinct()


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'""")
def intersect(t: Tables):
    return t.events.where("event_type = 'click'").select("user_id").intersect(t.events.where("event_type = 'error'").select("user_id"))


@query("""SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'error'""")
def except_all(t: Tables):
    return t.events.where("event_type = 'click'").select("user_id").exceptAll(t.events.where("event_type = 'error'").select("user_id"))


@query("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables):
    l = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
