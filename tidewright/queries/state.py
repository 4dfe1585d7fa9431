"""Keyed state, state machines, markers, schemas."""

from pyspark.sql import functions as F

from tidewright.operators import state as op
from tidewright.operators.rows import messages
from tidewright.plans import schema as sc
from tidewright.queries.registry import Tables, query

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, COUNT(*) {_W} AS counter, ROUND(SUM(value) {_W}, 4) AS total FROM events")
def state_counter(t: Tables):
    d = op.counter(t.events, ["user_id"], ["ts", "event_id"])
    d = op.counter(d, ["user_id"], ["ts", "event_id"], "total", F.col("value"))
    return d.select("event_id", "counter", F.round("total", 4).alias("total"))


@query("SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gauge FROM events")
def state_gauge(t: Tables):
    e = t.events.withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return op.gauge(e, ["user_id"], ["ts", "event_id"], "paid").select("event_id", "gauge")


@query("""WITH o AS (SELECT *, COALESCE(ts > LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY, FALSE) AS fresh FROM events),
s AS (SELECT *, SUM(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS counter FROM s""")
def state_ttl(t: Tables):
    return op.counter_with_ttl(t.events, ["user_id"], "ts", ["event_id"], "1 day").select("event_id", "counter")


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) AS buffer FROM events GROUP BY 1""")
def buffer_priority(t: Tables):
    return op.buffer(t.events, ["user_id"], ["event_id"], F.col("event_id").cast("string"), "priority", F.col("value")).select("user_id", F.concat_ws(",", "buffer").alias("buffer"))


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS buffer FROM events GROUP BY 1""")
def buffer_lifo(t: Tables):
    return op.buffer(t.events, ["user_id"], ["ts", "event_id"], F.col("event_id").cast("string"), "lifo").select("user_id", F.concat_ws(",", "buffer").alias("buffer"))


@query("""SELECT event_id, CASE WHEN p IS NULL THEN event_type = 'signup' ELSE event_type = 'error' OR (p = 'signup' AND event_type IN ('view', 'click')) OR (p = 'view' AND event_type IN ('click', 'view')) OR (p = 'click' AND event_type = 'purchase') END AS valid
FROM (SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def state_machine_check(t: Tables):
    m = op.StateMachine("signup", {"*": ["error"], "signup": ["view", "click"], "view": ["click", "view"], "click": ["purchase"]})
    return m.check(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "valid")


@query("""SELECT event_id FROM events WHERE ts >= (SELECT MAX(ts) FROM (SELECT ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100))""")
def marker_threshold(t: Tables):
    m = op.marker_at_count(t.events, "many_errors", ["ts", "event_id"], 100, F.col("event_type") == "error")
    return op.phase(t.events, "ts", m, after="many_errors").select("event_id")


@query("""SELECT event_id FROM events WHERE ts < (SELECT MIN(ts) FROM events WHERE value > 99)""")
def phase_filter(t: Tables):
    m = op.marker_at_signal(t.events, "peak", "ts", F.col("value") > 99)
    return op.phase(t.events, "ts", m, before="peak").select("event_id")


@query("""SELECT event_id, COUNT(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY e RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) >= 2 AS poison FROM (SELECT *, CAST(FLOOR(epoch(ts)) AS BIGINT) AS e FROM events)""")
def poison_pill(t: Tables):
    return op.poison(t.events, ["user_id"], "ts", F.col("event_type") == "error", 2, 43200).select("event_id", "poison")


def _part_schema(version="2.1.0"):
    return sc.Schema(
        "part",
        [sc.Field("p_partkey", "integer", required=True), sc.Field("p_name", "string", length=(1, 12)), sc.Field("p_brand", "string", pattern="Brand#[1-3][0-9]"), sc.Field("p_size", "integer", low=1, high=40), sc.Field("p_retailprice", "decimal", precision=(12, 2))],
        version,
        computed={"double_price": F.col("p_retailprice") * 2},
    )


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT LENGTH(p_name) BETWEEN 1 AND 12 THEN 'p_name has a wrong length' END, CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]') THEN 'p_brand does not match' END, CASE WHEN p_size < 1 THEN 'p_size is below 1' END, CASE WHEN p_size > 40 THEN 'p_size is above 40' END], lambda x: x IS NOT NULL), '; ') AS messages FROM part""")
def schema_constraints(t: Tables):
    s = _part_schema()
    return s.conform(t.part).select("p_partkey", F.concat_ws("; ", messages(s.checks())).alias("messages"))


@query("""SELECT p_partkey, ROUND(p_retailprice * 2, 2) AS double_price FROM part""")
def computed_fields(t: Tables):
    return _part_schema().conform(t.part).select("p_partkey", F.round(F.col("double_price").cast("double"), 2).alias("double_price"))


@query("""SELECT p_partkey, p_type AS p_name, CAST(p_size AS BIGINT) AS p_size FROM part""")
def migration_map(t: Tables):
    return _part_schema().migrate(t.part.withColumnRenamed("p_name", "title"), "2.0.3", {"p_name": "p_type"}).select("p_partkey", "p_name", "p_size")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' END AS label, o_orderstatus = 'P' AS deprecated FROM orders""")
def reference_entries(t: Tables):
    e = sc.entries(t.spark, [("O", "open"), ("F", "filled"), ("P", "partial")], "code string, label string", ["P"])
    return t.orders.join(F.broadcast(e), F.col("o_orderstatus") == F.col("code"), "left").select("o_orderkey", "label", "deprecated")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, ts AS since, CAST(1 AS BIGINT) AS counter FROM s WHERE r = 1 UNION ALL
SELECT s.user_id, s.event_id, s.r, CASE WHEN s.ts > f.since + INTERVAL 1 DAY THEN s.ts ELSE f.since END, CASE WHEN s.ts > f.since + INTERVAL 1 DAY THEN 1 ELSE f.counter + 1 END FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1)
SELECT event_id, counter FROM f""")
def state_ttl_absolute(t: Tables):
    return op.counter_with_absolute_ttl(t.events, ["user_id"], "ts", ["event_id"], "1 day").select("event_id", "counter")


@query("""SELECT event_id, p AS from_state, event_type AS to_state, CASE WHEN NOT (event_type = 'error' OR (p = 'view' AND event_type = 'click') OR (p = 'click' AND event_type = 'purchase')) THEN NULL WHEN p = 'click' AND event_type = 'purchase' THEN 'celebrate' WHEN event_type = 'error' THEN 'report' END AS action
FROM (SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p <> event_type""")
def state_transitions(t: Tables):
    m = op.StateMachine("view", {"*": ["error"], "view": ["click"], "click": ["purchase"]})
    moved = m.transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type", {("*", "error"): "report", ("click", "purchase"): "celebrate"})
    return moved.select("event_id", "from_state", "to_state", "action")


@query("""WITH e AS (SELECT MIN(ts) AS a FROM events WHERE event_type = 'error'), p AS (SELECT MIN(ts) AS a FROM events WHERE value > 99),
q AS (SELECT MIN(ts) + INTERVAL 3 HOUR AS a FROM (SELECT ts, LEAD(ts) OVER (ORDER BY ts) AS n FROM events) WHERE n IS NULL OR n > ts + INTERVAL 3 HOUR)
SELECT 'both' AS marker, GREATEST((SELECT a FROM e), (SELECT a FROM p)) AS at UNION ALL SELECT 'either', LEAST((SELECT a FROM e), (SELECT a FROM p)) UNION ALL SELECT 'later', (SELECT a FROM e) + INTERVAL 2 HOUR UNION ALL SELECT 'drained', a FROM q""")
def marker_conditions(t: Tables):
    e, p = (op.marker_at_signal(t.events, n, "ts", c) for n, c in (("error", F.col("event_type") == "error"), ("peak", F.col("value") > 99)))
    known = e.unionByName(p)
    out = op.marker_of(known, "both", ["error", "peak"]).unionByName(op.marker_of(known, "either", ["error", "peak"], every=False))
    return out.unionByName(op.marker_after(known, "later", "error", "2 hours")).unionByName(op.marker_when_drained(t.events, "drained", "ts", "3 hours"))
