"""Decision tables and procedural rules."""

from pyspark.sql import functions as F

from tidewright.operators import decide as d
from tidewright.queries.registry import Tables, query


def _customer_table():
    return d.DecisionTable(
        [
            d.Row({"c_acctbal": d.at_least(8000), "c_mktsegment": d.one_of("BUILDING", "MACHINERY")}, {"tier": F.lit("A"), "rate": F.lit(0.5)}, 3),
            d.Row({"c_acctbal": d.span(2000, 7999.99)}, {"tier": F.lit("B"), "rate": F.col("c_acctbal") / 10000}, 1),
            d.Row({"c_mktsegment": d.starts("AUTO")}, {"tier": F.lit("C"), "rate": F.lit(0.2)}, 2),
            d.Row({"c_acctbal": d.less(0)}, {"tier": F.lit("D")}, 5),
        ],
        {"tier": "string", "rate": "double"},
        "customer_tier",
    )


_HITS = ["c_acctbal >= 8000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_acctbal BETWEEN 2000 AND 7999.99", "c_mktsegment LIKE 'AUTO%'", "c_acctbal < 0"]
_COUNT = " + ".join(f"CAST({h} AS INT)" for h in _HITS)


@query(f"""SELECT c_custkey, CASE WHEN {_HITS[0]} THEN 'A' WHEN {_HITS[1]} THEN 'B' WHEN {_HITS[2]} THEN 'C' WHEN {_HITS[3]} THEN 'D' END AS tier,
ROUND(CASE WHEN {_HITS[0]} THEN 0.5 WHEN {_HITS[1]} THEN c_acctbal / 10000 WHEN {_HITS[2]} THEN 0.2 END, 8) AS rate FROM customer""")
def dt_first_match(t: Tables):
    return _customer_table().apply(t.customer).select("c_custkey", "tier", F.round("rate", 8).alias("rate"))


@query(f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN {_HITS[0]} THEN 'A' END, CASE WHEN {_HITS[1]} THEN 'B' END, CASE WHEN {_HITS[2]} THEN 'C' END, CASE WHEN {_HITS[3]} THEN 'D' END], lambda x: x IS NOT NULL), ',') AS tiers FROM customer""")
def dt_multi_hit(t: Tables):
    return _customer_table().apply(t.customer, "multi").select("c_custkey", F.concat_ws(",", F.transform("hits", lambda h: h["tier"])).alias("tiers"))


@query(f"""SELECT c_custkey, {_COUNT} AS hits, CASE WHEN {_COUNT} = 1 THEN CASE WHEN {_HITS[0]} THEN 'A' WHEN {_HITS[1]} THEN 'B' WHEN {_HITS[2]} THEN 'C' ELSE 'D' END END AS tier FROM customer""")
def dt_single_hit(t: Tables):
    table = _customer_table()
    return t.customer.select("c_custkey", table.hit_count().alias("hits"), table.single_hit()["tier"].alias("tier"))


@query(f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN {_HITS[3]} THEN 'D' END, CASE WHEN {_HITS[0]} THEN 'A' END, CASE WHEN {_HITS[2]} THEN 'C' END, CASE WHEN {_HITS[1]} THEN 'B' END], lambda x: x IS NOT NULL), ',') AS tiers FROM customer""")
def dt_collect_priority(t: Tables):
    return _customer_table().apply(t.customer, "collect").select("c_custkey", F.concat_ws(",", F.transform("hits", lambda h: h["tier"])).alias("tiers"))


@query(f"""SELECT c_custkey, ROUND(CASE WHEN {_HITS[0]} THEN 0.5 WHEN {_HITS[1]} THEN c_acctbal / 10000 WHEN {_HITS[2]} THEN 0.2 END * c_acctbal, 6) AS charge,
CASE WHEN {_HITS[0]} OR {_HITS[1]} OR {_HITS[2]} THEN 'priced' ELSE 'free' END AS kind FROM customer""")
def dt_post_calculate(t: Tables):
    rated = _customer_table().apply(t.customer)
    return rated.select("c_custkey", F.round(F.col("rate") * F.col("c_acctbal"), 6).alias("charge"), F.when(F.col("rate").isNotNull(), "priced").otherwise("free").alias("kind"))


@query(f"""SELECT c_custkey, ROUND(COALESCE(CASE WHEN {_HITS[0]} THEN 0.5 ELSE 0 END + CASE WHEN {_HITS[1]} THEN c_acctbal / 10000 ELSE 0 END + CASE WHEN {_HITS[2]} THEN 0.2 ELSE 0 END, 0), 6) AS total FROM customer""")
def dt_aggregate_hits(t: Tables):
    hits = F.aggregate(F.transform(_customer_table().hits(), lambda h: F.coalesce(h["rate"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return t.customer.select("c_custkey", F.round(hits, 6).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'none' WHEN p_brand NOT IN ('Brand#11', 'Brand#12') AND regexp_full_match(p_type, '.*BRASS') AND p_size <> 5 THEN 'x' WHEN (p_size > 40 OR p_size < 5) AND p_size <> 3 THEN 'y' ELSE 'z' END AS kind FROM (SELECT * EXCLUDE (p_size), CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p_size FROM part)""")
def dt_cells(t: Tables):
    p = t.part.withColumn("p_size", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")))
    table = d.DecisionTable(
        [
            d.Row({"p_size": d.missing}, {"kind": F.lit("none")}),
            d.Row({"p_brand": d.none_of("Brand#11", "Brand#12"), "p_type": d.full_match(".*BRASS"), "p_size": d.unlike(5)}, {"kind": F.lit("x")}),
            d.Row({"p_size": d.chain(d.more(40), ("or", d.less(5)), ("and", d.unlike(3)))}, {"kind": F.lit("y")}),
            d.Row({"p_name": d.anything}, {"kind": F.lit("z")}),
        ],
        {"kind": "string"},
    )
    return table.apply(p).select("p_partkey", "kind")


@query("""SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def dt_exact_join(t: Tables):
    table = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return d.exact_table(t.nation, table, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 90 WHEN o_totalprice > 100000 AND o_orderstatus = 'P' THEN 60 WHEN o_totalprice > 100000 THEN 50 ELSE 10 END AS score,
CASE WHEN o_totalprice > 250000 THEN 'review' WHEN o_totalprice > 100000 AND o_orderstatus = 'P' THEN 'hold,log' WHEN o_totalprice > 100000 THEN 'log' ELSE 'log' END AS actions FROM orders""")
def procedural_rule(t: Tables):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    rule = [
        d.If(
            [(price > 250000, [d.Set("score", F.lit(90)), d.Act("review"), d.Return()]), (price > 100000, [d.Set("score", F.lit(50)), d.If([(status == "P", [d.Set("score", F.col("score") + 10), d.Act("hold")])])])],
            [d.Set("score", F.lit(10))],
        ),
        d.Act("log"),
    ]
    return d.procedure(t.orders, rule).select("o_orderkey", "score", F.concat_ws(",", "actions").alias("actions"))


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN ['flag_for_review', 'send_alert'] WHEN o_totalprice > 100000 THEN ['require_verification'] ELSE ['approve_transaction'] END AS acts FROM orders)
SELECT o_orderkey, CAST(i - 1 AS INT) AS place, acts[i] AS action, CASE acts[i] WHEN 'send_alert' THEN 'communication' WHEN 'approve_transaction' THEN 'transaction_authorization' ELSE 'risk_management' END AS category FROM a, UNNEST(range(1, len(acts) + 1)) AS u(i)""")
def action_catalogue(t: Tables):
    price = F.col("o_totalprice")
    rules = [d.If([(price > 200000, [d.act("flagForReview"), d.act("sendAlert")]), (price > 100000, [d.act("requireVerification")])], [d.act("approveTransaction")])]
    return d.action_requests(d.procedure(t.orders, rules), ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "place", "action", "category")
