"""Sources, projections, filters, routes, validation, branches, duplicates."""

from pyspark.sql import functions as F

from tidewright.functions import runtime as rt
from tidewright.operators import rows as op
from tidewright.operators import transforms as tf
from tidewright.operators.privacy import mask_records
from tidewright.queries.registry import Tables, query
from tidewright.sources import readers


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def passthrough_project(t: Tables):
    return op.project(t.customer, "c_custkey", "c_name", "c_mktsegment")


@query("SELECT * EXCLUDE (c_acctbal, c_nationkey) FROM customer")
def project_except(t: Tables):
    return op.project_except(t.customer, "c_acctbal", "c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def receive_filter(t: Tables):
    return readers.parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"], where=(F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'")
def timestamp_bounds(t: Tables):
    return readers.parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_orderdate"], "o_orderdate", "1995-01-01", "1996-06-30")


@query("""SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, event_type FROM events)
WHERE NOT COALESCE(v > 50, FALSE) AND COALESCE(event_type ILIKE 'c%', FALSE)""")
def filter_twovalued(t: Tables):
    e = t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return e.where(~op.two_valued(F.col("v") > 50) & op.like(F.col("event_type"), "C%")).select("event_id")


@query("""SELECT CAST(t AS TIMESTAMP) AS tick FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 3 HOUR) g(t)""")
def scheduler_ticks(t: Tables):
    return readers.ticks(t.spark, "2024-01-01", "2024-01-02", "3 hours").select(F.col("tick").cast("timestamp_ntz").alias("tick"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def decode_json(t: Tables):
    return readers.decode_json(t.events, "props", "k bigint").select("event_id", F.col("props.k").alias("k"))


@query("""SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem""")
def transform_map(t: Tables):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    step = tf.Transform({"net": F.round(net, 4), "gross": F.round(net * (1 + F.col("l_tax")), 6)})
    return step(t.lineitem).select("l_orderkey", "l_linenumber", "net", "gross")


@query("""SELECT l_orderkey, l_linenumber, ROUND(l_quantity * 2 + 1, 4) AS b FROM lineitem""")
def transform_locals(t: Tables):
    return op.assign(t.lineitem, [("a", F.col("l_quantity") * 2), ("b", F.round(F.col("a") + 1, 4))], drop=["a"]).select("l_orderkey", "l_linenumber", "b")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders""")
def transform_conditional(t: Tables):
    band = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    return t.orders.select("o_orderkey", band.alias("band"))


@query("""SELECT event_id, COALESCE(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, CASE WHEN event_id % 2 = 0 THEN NULL ELSE -1.0 END, 0.0) AS v FROM events""")
def null_coalesce(t: Tables):
    first = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.events.select("event_id", F.coalesce(first, F.when(F.col("event_id") % 2 != 0, F.lit(-1.0)), F.lit(0.0)).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, ROUND(x * 1.1, 6) AS y FROM (SELECT *, l_extendedprice - 1 AS x FROM lineitem) WHERE x > 1000""")
def compose_sequential(t: Tables):
    steps = tf.sequential(tf.Transform({"x": F.col("l_extendedprice") - 1}), lambda d: d.where("x > 1000"), tf.Transform({"y": F.round(F.col("x") * 1.1, 6)}))
    return steps(t.lineitem).select("l_orderkey", "l_linenumber", "y")


@query("""SELECT l_orderkey, l_linenumber, ROUND(l_tax * 2, 4) AS a_v, ROUND(l_discount * 3, 4) AS b_v FROM lineitem""")
def compose_parallel(t: Tables):
    both = tf.side_by_side(t.lineitem, tf.Transform({"v": F.round(F.col("l_tax") * 2, 4)}, name="a"), tf.Transform({"v": F.round(F.col("l_discount") * 3, 4)}, name="b"))
    return both.select("l_orderkey", "l_linenumber", F.col("a.v").alias("a_v"), F.col("b.v").alias("b_v"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_returnflag = 'A' THEN l_quantity * 2 ELSE l_quantity END AS l_quantity FROM lineitem""")
def compose_conditional(t: Tables):
    done = tf.conditional(t.lineitem, [(F.col("l_returnflag") == "R", tf.Transform({"l_quantity": F.lit(0.0)})), (F.col("l_returnflag") == "A", tf.Transform({"l_quantity": F.col("l_quantity") * 2}))])
    return done.select("l_orderkey", "l_linenumber", "l_quantity")


def _order_checks():
    return [
        op.Check(F.col("o_totalprice") > 50000, "too cheap", "E1"),
        op.Check(F.col("o_orderpriority") != "1-URGENT", "urgent", "E2", "warning"),
        op.Check(F.col("o_orderstatus") == "O", "open only", "E3", when=F.col("o_totalprice") > 150000),
    ]


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 50000 THEN 'too cheap' END, CASE WHEN NOT o_orderpriority <> '1-URGENT' THEN 'urgent' END,
CASE WHEN o_totalprice > 150000 AND NOT o_orderstatus = 'O' THEN 'open only' END], lambda x: x IS NOT NULL), '; ') AS messages FROM orders""")
def validate_collect_errors(t: Tables):
    return t.orders.select("o_orderkey", F.concat_ws("; ", op.messages(_order_checks())).alias("messages"))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderpriority <> '1-URGENT' AND (o_totalprice <= 150000 OR o_orderstatus = 'O')""")
def validate_accept(t: Tables):
    return op.validate(t.orders, _order_checks())[0].select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 50000 AND o_orderpriority <> '1-URGENT' AND (o_totalprice <= 150000 OR o_orderstatus = 'O'))""")
def validate_reject(t: Tables):
    return op.validate(t.orders, _order_checks())[1].select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN o_totalprice ELSE 0.0 END AS o_totalprice FROM orders""")
def on_error_default(t: Tables):
    good, _ = op.guard(t.orders, _order_checks()[:1], op.OnError("default", {"o_totalprice": F.lit(0.0)}))
    return good.select("o_orderkey", "o_totalprice")


@query("""SELECT 'validate' AS stage, 'too cheap' AS messages, COUNT(*) AS n FROM orders WHERE NOT o_totalprice > 50000""")
def dead_letter(t: Tables):
    _, bad = op.validate(t.orders, _order_checks()[:1])
    letters = op.dead_letters(bad, "validate", F.lit("2024-01-01").cast("timestamp"))
    return letters.groupBy("stage", F.concat_ws("; ", "messages").alias("messages")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 AND o_orderstatus = 'F' THEN 'matched' ELSE 'default' END AS decision FROM orders""")
def route_inline(t: Tables):
    return op.route(t.orders, (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "decision")


@query("""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'default' END AS target, COUNT(*) AS n FROM orders GROUP BY 1""")
def route_table(t: Tables):
    outputs = op.destinations(t.orders, F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return op.merge(*(d.select(F.lit(k).alias("target")) for k, d in outputs.items())).groupBy("target").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'gold' WHEN c_acctbal > 4000 THEN 'silver' ELSE 'bronze' END AS tier FROM customer""")
def split_tiers(t: Tables):
    return op.split(t.customer, [("gold", F.col("c_acctbal") > 8000), ("silver", F.col("c_acctbal") > 4000)], "bronze").select("c_custkey", "tier")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events""")
def branch_step(t: Tables):
    return op.branch(t.events, F.col("event_type") == "error", lambda d: d.withColumn("value", -F.col("value"))).select("event_id", "value")


@query("""SELECT 'all' AS branch, COUNT(*) AS n FROM events UNION ALL SELECT 'big', COUNT(*) FROM events WHERE value > 50""")
def parallel_union(t: Tables):
    both = op.parallel(t.events, {"all": lambda d: d, "big": lambda d: d.where("value > 50")}, "branch")
    return both.groupBy("branch").agg(F.count("*").alias("n"))


@query("""SELECT user_id, COUNT(DISTINCT b) AS branches FROM (SELECT user_id, 'c' b FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 'v' FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'e' FROM events WHERE event_type = 'error')
GROUP BY user_id HAVING COUNT(DISTINCT b) >= 2""")
def min_required_branches(t: Tables):
    parts = {n: (lambda k: lambda d: d.where(F.col("event_type") == k))(k) for n, k in (("c", "click"), ("v", "view"), ("e", "error"))}
    return op.min_required(op.parallel(t.events, parts, "b"), ["user_id"], "b", 2)


@query("""SELECT event_type, COUNT(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE user_id % 2 = 0) GROUP BY 1""")
def merge_union(t: Tables):
    return op.merge(t.events, t.events.where("user_id % 2 = 0")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, u.account, u.amount FROM lineitem, LATERAL (SELECT UNNEST([{'account': 'goods', 'amount': ROUND(l_extendedprice, 2)}, {'account': 'tax', 'amount': ROUND(l_extendedprice * l_tax, 4)}], recursive := TRUE)) u""")
def fanout_ledger(t: Tables):
    record = lambda a, v: F.struct(F.lit(a).alias("account"), v.alias("amount"))
    return op.fan_out(t.lineitem, record("goods", F.round("l_extendedprice", 2)), record("tax", F.round(F.col("l_extendedprice") * F.col("l_tax"), 4)), keep_columns=["l_orderkey", "l_linenumber"])


@query("""SELECT event_id, user_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def dedupe_first(t: Tables):
    return op.first_by_key(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT event_id FROM (SELECT event_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts > p + INTERVAL 6 HOUR""")
def dedupe_window(t: Tables):
    return op.first_in_window(t.events, ["user_id"], "ts", "6 hours", ["event_id"]).select("event_id")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END], lambda x: x IS NOT NULL), ',') AS flags,
CAST(o_orderstatus AS VARCHAR) AS meta, CASE WHEN o_totalprice > 200000 THEN 15 ELSE 5 END AS score FROM orders""")
def flags_metadata_score(t: Tables):
    d = op.add_flag(t.orders, "large", F.col("o_totalprice") > 200000)
    d = op.add_flag(d, "partial", F.col("o_orderstatus") == "P")
    d = op.add_metadata(d, "status", F.col("o_orderstatus"))
    d = op.adjust_score(d.withColumn("score", F.lit(5)), F.when(F.col("o_totalprice") > 200000, 10).otherwise(0))
    return d.select("o_orderkey", F.concat_ws(",", "flags").alias("flags"), F.col("metadata")["status"].alias("meta"), "score")


@query("""SELECT 'order_seen' AS event, o_orderstatus AS actor, COUNT(*) AS n FROM orders GROUP BY o_orderstatus""")
def audit_events(t: Tables):
    a = op.audit_events(t.orders, "order_seen", F.col("o_orderstatus"), ["o_orderkey"], F.col("o_orderdate"))
    return a.groupBy("event", "actor").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS correlation_id, 'ledger' AS target, 'committed' AS status, o_totalprice FROM orders""")
def completion_events(t: Tables):
    return op.completion_events(t.orders, "ledger", "o_orderkey", ["o_totalprice"])


@query("""SELECT event_id, ts + INTERVAL 90 MINUTE AS due_at, 'remind' AS action FROM events""")
def schedule_after(t: Tables):
    return op.due(t.events, "ts", "90 minutes", "remind").select("event_id", "due_at", "action")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b|\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{3}[-.]\d{3}[-.]\d{4}\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') THEN '***' ELSE text END AS text, '***' AS source FROM documents""")
def pii_mask(t: Tables):
    return mask_records(t.documents.select("doc_id", "text", "source"), ["data_source"]).select("doc_id", "text", "source")


@query("""SELECT event_id, p IS NULL OR (event_type, v) IS DISTINCT FROM (pt, pv) AS changed FROM (SELECT *, LAG(event_id) OVER w AS p, LAG(event_type) OVER w AS pt, LAG(v) OVER w AS pv
FROM (SELECT *, CAST(FLOOR(value / 25) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def onchange_recalc(t: Tables):
    e = t.events.withColumn("v", F.floor(F.col("value") / 25))
    return tf.on_change(e, ["user_id"], ["ts", "event_id"], ["event_type", "v"]).select("event_id", "changed")


@query("""SELECT p_partkey, CAST(COALESCE(LENGTH(b), 0) AS INT) AS n, COALESCE(b LIKE 'Brand#1%', FALSE) AS s, COALESCE(b = '', TRUE) AS e FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS b FROM part)""")
def fn_null_rules(t: Tables):
    b = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", rt.length(b).alias("n"), rt.starts_with(b, "Brand#1").alias("s"), rt.is_empty(b).alias("e"))


@query("""SELECT o_orderkey, branch FROM (SELECT o_orderkey, 'large' AS branch, o_totalprice > 100000 AS a, o_orderstatus = 'O' AS b FROM orders UNION ALL SELECT o_orderkey, 'open', o_totalprice > 100000, o_orderstatus = 'O' FROM orders) WHERE a AND b""")
def parallel_require_all(t: Tables):
    branches = {"large": lambda d: d.where("o_totalprice > 100000"), "open": lambda d: d.where("o_orderstatus = 'O'")}
    return op.parallel_required(t.orders, branches, ["o_orderkey"]).select("o_orderkey", "branch")


@query("""SELECT event_id, CASE WHEN event_type LIKE 'err%' THEN 'retry' WHEN event_type = 'view' THEN 'skip' ELSE 'dead_letter' END AS policy FROM events""")
def error_policies(t: Tables):
    by = op.by_error_class(t.events, "event_type", {"err*": "retry", "view": "skip"})
    parts = [by[p].select("event_id", F.lit(p).alias("policy")) for p in ("retry", "skip", "dead_letter", "fail")]
    return op.merge(*parts)
