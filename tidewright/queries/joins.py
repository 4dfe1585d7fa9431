"""Joins, enrichment, lookups, correlation, comparison of streams."""

from pyspark.sql import functions as F

from tidewright.operators import correlate as co
from tidewright.operators import joins as op
from tidewright.operators.sql import match_rows, sql
from tidewright.queries.registry import Tables, query


def _clicks(t: Tables):
    return t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("c_ts"), F.col("event_id").alias("c_id"))


def _buys(t: Tables):
    return t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))


_SIDES = "WITH c AS (SELECT user_id, ts AS c_ts, event_id AS c_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts AS p_ts, event_id AS p_id FROM events WHERE event_type = 'purchase') "
_NEAR = "c.user_id = p.user_id AND p_ts BETWEEN c_ts - INTERVAL 12 HOUR AND c_ts + INTERVAL 12 HOUR"


@query(_SIDES + f"SELECT c.user_id, c_id, p_id FROM c JOIN p ON {_NEAR}")
def interval_join_inner(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "12 hours", "12 hours").select("user_id", "c_id", "p_id")


@query(_SIDES + f"SELECT c.user_id, c_id, p_id FROM c JOIN p ON {_NEAR}")
def interval_join_bucketed(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "12 hours", "12 hours", bucket_seconds=43200).select("user_id", "c_id", "p_id")


@query(_SIDES + f"SELECT c.user_id, c_id, p_id FROM c LEFT JOIN p ON {_NEAR}")
def interval_join_left(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "12 hours", "12 hours", "left").select("user_id", "c_id", "p_id")


@query(_SIDES + f"SELECT p.user_id, c_id, p_id FROM c RIGHT JOIN p ON {_NEAR}")
def interval_join_right(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "12 hours", "12 hours", "right").select("user_id", "c_id", "p_id")


@query(_SIDES + f"SELECT COALESCE(c.user_id, p.user_id) AS user_id, c_id, p_id FROM c FULL JOIN p ON {_NEAR}")
def interval_join_full(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "12 hours", "12 hours", "full").select("user_id", "c_id", "p_id")


@query(_SIDES + "SELECT c.user_id, c_id, p_id FROM c JOIN p ON c.user_id = p.user_id AND p_ts BETWEEN c_ts - INTERVAL 1 HOUR AND c_ts + INTERVAL 24 HOUR")
def interval_join_asymmetric(t: Tables):
    return op.interval_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "1 hour", "24 hours").select("user_id", "c_id", "p_id")


@query(_SIDES + "SELECT c.user_id, c_id, p_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND time_bucket(INTERVAL 6 HOUR, c_ts, TIMESTAMP '1970-01-01') = time_bucket(INTERVAL 6 HOUR, p_ts, TIMESTAMP '1970-01-01')")
def cogroup_left(t: Tables):
    return op.cogroup_join(_clicks(t), _buys(t), ["user_id"], "c_ts", "p_ts", "6 hours").select("user_id", "c_id", "p_id")


@query("""SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def enrich_dim(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    d = op.enrich(o, t.customer, ["c_custkey"], ["c_name", "c_nationkey"])
    return op.enrich(d.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], ["n_name"]).select("o_orderkey", "c_name", "n_name")


@query("""SELECT c_custkey, COALESCE(CASE WHEN n_regionkey = 2 THEN n_name END, 'elsewhere') AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_default(t: Tables):
    asia = t.nation.where("n_regionkey = 2").withColumnRenamed("n_nationkey", "c_nationkey")
    return op.lookup_or(t.customer, asia, ["c_nationkey"], "n_name", "elsewhere", "place").select("c_custkey", "place")


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey""")
def lookup_found(t: Tables):
    rich = t.customer.where("c_acctbal > 5000").withColumnRenamed("c_custkey", "o_custkey")
    return op.lookup(t.orders, rich, ["o_custkey"], ["c_name"]).select("o_orderkey", "found")


@query("""WITH h AS (SELECT user_id, ts AS eff, MAX(value) AS rate FROM events WHERE event_type = 'view' GROUP BY 1, 2), q AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT q.event_id, h.rate FROM q ASOF LEFT JOIN h ON q.user_id = h.user_id AND q.ts >= h.eff""")
def lookup_asof(t: Tables):
    h = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("eff"), F.col("value").alias("rate"))
    return op.lookup_as_of(t.events.where("event_type = 'purchase'"), h, ["user_id"], "ts", "eff", ["rate"]).select("event_id", "rate")


@query("""WITH h AS (SELECT user_id, ts AS s, event_id AS h_id, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type = 'signup')
SELECT q.event_id, h.h_id FROM (SELECT * FROM events WHERE event_type = 'error') q LEFT JOIN h ON q.user_id = h.user_id AND q.ts >= s AND (e IS NULL OR q.ts < e)""")
def lookup_valid_range(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("s"), F.lead("ts").over(w).alias("e"), F.col("event_id").alias("h_id"))
    return op.lookup_valid(t.events.where("event_type = 'error'"), h, ["user_id"], "ts", "s", "e", ["h_id"]).select("event_id", "h_id")


@query("""SELECT c_custkey, 'has' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_anti(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    has = op.semi(t.customer, o, ["c_custkey"]).select("c_custkey", F.lit("has").alias("kind"))
    return has.unionByName(op.anti(t.customer, o, ["c_custkey"]).select("c_custkey", F.lit("none").alias("kind")))


@query("""SELECT l.doc_id, l.quality FROM labels l SEMI JOIN documents d ON l.doc_id = d.doc_id""")
def buffer_match(t: Tables):
    return op.match_from_buffer(t.labels, t.documents.select("doc_id"), ["doc_id"]).select("doc_id", "quality")


_SEQ = """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IN ('view', 'purchase')),
q AS (SELECT *, LAG(side) OVER w ps, LAG(ts) OVER w pt, LAG(event_id) OVER w pid, LEAD(side) OVER w ns, LEAD(ts) OVER w nt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, side, event_id)) """


def _await(t: Tables):
    e = t.events
    return co.await_match(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", "24 hours")


@query(_SEQ + "SELECT user_id, pid AS first_id, event_id AS second_id FROM q WHERE side = 1 AND ps = 0 AND ts <= pt + INTERVAL 24 HOUR")
def await_match(t: Tables):
    return _await(t).where("outcome = 'matched'").select("user_id", "first_id", "second_id")


@query(_SEQ + "SELECT user_id, event_id AS first_id, ts + INTERVAL 24 HOUR AS at FROM q WHERE side = 0 AND NOT COALESCE(nt <= ts + INTERVAL 24 HOUR, FALSE)")
def await_timeout(t: Tables):
    return _await(t).where("outcome = 'timeout'").select("user_id", "first_id", "at")


@query(_SEQ + "SELECT user_id, event_id AS second_id FROM q WHERE side = 1 AND NOT COALESCE(ps = 0 AND ts <= pt + INTERVAL 24 HOUR, FALSE)")
def await_unmatched(t: Tables):
    return _await(t).where("outcome = 'unmatched'").select("user_id", "second_id")


_HOLD = "WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events), b AS (SELECT *, r // 5 AS batch, COUNT(*) OVER (PARTITION BY user_id, r // 5) AS size FROM n) "


@query(_HOLD + "SELECT user_id, CAST(batch AS BIGINT) AS batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS ids FROM b WHERE size = 5 GROUP BY 1, 2")
def hold_count(t: Tables):
    full, _ = co.hold_count(t.events, ["user_id"], ["ts", "event_id"], 5, F.col("event_id").cast("string"))
    return full.select("user_id", F.col("batch").cast("bigint").alias("batch"), F.concat_ws(",", "held").alias("ids"))


@query(_HOLD + "SELECT event_id FROM b WHERE size < 5")
def hold_timeout(t: Tables):
    return co.hold_count(t.events, ["user_id"], ["ts", "event_id"], 5, F.col("event_id"))[1].select("event_id")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, ts AS since, 1 AS buffer, 1 AS size FROM s WHERE r = 1 UNION ALL
SELECT s.user_id, s.event_id, s.r, CASE WHEN f.size >= 3 OR s.ts > f.since + INTERVAL 12 HOUR THEN s.ts ELSE f.since END, CASE WHEN f.size >= 3 OR s.ts > f.since + INTERVAL 12 HOUR THEN f.buffer + 1 ELSE f.buffer END, CASE WHEN f.size >= 3 OR s.ts > f.since + INTERVAL 12 HOUR THEN 1 ELSE f.size + 1 END FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1)
SELECT user_id, event_id, buffer, CASE WHEN MAX(size) OVER (PARTITION BY user_id, buffer) >= 3 THEN 'complete' ELSE 'timeout' END AS outcome FROM f""")
def hold_buffers(t: Tables):
    """Buffers with a timeout from their first row, complete at three rows."""
    held = co.hold_window(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"], "12 hours", 3)
    return held.select("user_id", "event_id", "buffer", "outcome")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 17 <> 0
UNION ALL SELECT o_orderkey + 10000000, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 19 = 0)
SELECT COALESCE(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN l.o_orderkey IS NULL THEN 'right_only' WHEN r.o_orderkey IS NULL THEN 'left_only' WHEN l.o_totalprice IS NOT DISTINCT FROM r.o_totalprice AND l.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus THEN 'match' ELSE 'different' END AS status,
CASE WHEN l.o_orderkey IS NULL OR r.o_orderkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN l.o_totalprice IS DISTINCT FROM r.o_totalprice THEN 'o_totalprice' END, CASE WHEN l.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END], lambda x: x IS NOT NULL), ',') END AS changed
FROM orders l FULL JOIN r ON l.o_orderkey = r.o_orderkey""")
def stream_diff(t: Tables):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    r = o.where("o_orderkey % 17 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    r = r.unionByName(o.where("o_orderkey % 19 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000))
    return op.diff(o, r, "o_orderkey", ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "status", F.concat_ws(",", "changed").alias("changed"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_acctbal * 2 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal * 2 FROM customer WHERE c_custkey % 50 = 0""")
def sql_merge_emulated(t: Tables):
    c = t.customer.select("c_custkey", "c_acctbal")
    s = c.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), (F.col("c_custkey") % 8 == 0).alias("gone"))
    s = s.unionByName(c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit(False).alias("gone")))
    return op.merge_into(c, s, "c_custkey", ["c_acctbal"], F.col("gone"))


@query("""WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total FROM customer JOIN spend ON c_custkey = o_custkey GROUP BY 1""")
def sql_cte(t: Tables):
    return sql("WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total FROM customer JOIN spend ON c_custkey = o_custkey GROUP BY 1", orders=t.orders, customer=t.customer)


@query("""SELECT l_orderkey, UNNEST(list(l_linenumber)) AS line FROM lineitem WHERE l_quantity > 25 GROUP BY 1""")
def sql_unnest(t: Tables):
    return sql("SELECT l_orderkey, line FROM (SELECT l_orderkey, collect_list(l_linenumber) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1) LATERAL VIEW explode(lines) x AS line", lineitem=t.lineitem)


@query("""WITH s AS (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events),
x AS (SELECT *, LEAD(event_type) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY r))
SELECT user_id, r AS first_row, r + 1 AS last_row FROM x WHERE event_type = 'view' AND n = 'purchase'""")
def sql_match_recognize(t: Tables):
    found = match_rows(t.events, ["user_id"], ["ts", "event_id"], {"V": F.col("event_type") == "view", "P": F.col("event_type") == "purchase"}, "VP")
    return found.select("user_id", "first_row", "last_row")


@query("""SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def region_revenue(t: Tables):
    o = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", "o_custkey")
    place = t.customer.select("c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    l = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount")
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query(_SEQ + "SELECT event_id AS first_id, 'late' AS reason FROM q WHERE side = 0 AND NOT COALESCE(nt <= ts + INTERVAL 24 HOUR, FALSE)")
def await_dead_letter(t: Tables):
    return co.on_timeout(_await(t), "dead_letter", "late")[1].select("first_id", "reason")
