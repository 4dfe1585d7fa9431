"""Function libraries over tables."""

from pyspark.sql import functions as F

from tidewright.functions import builtin as b
from tidewright.functions import cards, finance, risk
from tidewright.functions import domain as dm
from tidewright.functions import runtime as rt
from tidewright.queries.registry import Tables, query


@query("""SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, SUBSTRING(p_name, 3, 3) AS mid, REPLACE(p_type, 'A', '_') AS rep, CAST(strpos(p_brand, '#') - 1 AS INT) AS idx, LEFT(p_type, 3) AS l3, RIGHT(p_type, 3) AS r3,
p_brand LIKE '%#1%' AS has, LPAD(CAST(p_size AS VARCHAR), 5, '0') AS padded, CONCAT(p_brand, '-', p_size) AS joined, string_split(p_brand, '#')[2] AS part2 FROM part""")
def fn_string(t: Tables):
    n, br, ty = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", F.upper(n).alias("up"), F.lower(br).alias("low"), rt.substring(n, 2, 5).alias("mid"), rt.replace(ty, "A", "_").alias("rep"), b.index_of(br, "#").alias("idx"), b.left(ty, 3).alias("l3"), b.right(ty, 3).alias("r3"), rt.contains(br, "#1").alias("has"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), rt.concat(br, F.lit("-"), F.col("p_size")).alias("joined"), F.split(br, "#")[1].alias("part2"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS second, regexp_replace(p_type, '[AEIOU]', '', 'g') AS bare, regexp_full_match(p_brand, 'Brand#[12].') AS m, CASE WHEN strpos(p_type, 'E') > 0 THEN LEFT(p_type, strpos(p_type, 'E') - 1) || '3' || SUBSTRING(p_type, strpos(p_type, 'E') + 1) ELSE p_type END AS once FROM part""")
def fn_regex(t: Tables):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "([0-9])([0-9])", 2).alias("second"), F.regexp_replace("p_type", "[AEIOU]", "").alias("bare"), rt.matches(F.col("p_brand"), "Brand#[12].").alias("m"), b.replace_first(F.col("p_type"), "E", "3").alias("once"))


@query("""SELECT p_partkey, ABS(p_size - 25) AS a, LEAST(p_size, 10) AS lo, GREATEST(p_size, 10) AS hi, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, p_size * p_size * p_size AS cube, ROUND(p_retailprice * 15 / 100, 6) AS pct, LEAST(GREATEST(p_size, 5), 20) AS cl, ROUND(SQRT(p_retailprice), 8) AS sq, ROUND(LN(p_retailprice), 8) AS l, p_size % 7 AS md FROM part""")
def fn_math(t: Tables):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", F.abs(s - 25).alias("a"), rt.smaller(s, 10).alias("lo"), rt.larger(s, 10).alias("hi"), F.ceil(p).alias("c"), F.floor(p).alias("f"), rt.power(s, 3).alias("cube"), F.round(rt.percent_of(p, 15), 6).alias("pct"), b.clamp(s, 5, 20).alias("cl"), F.round(F.sqrt(p), 8).alias("sq"), F.round(F.ln(p), 8).alias("l"), (s % 7).alias("md"))


@query("""SELECT o_orderkey, CAST(YEAR(d) AS INT) AS y, CAST(MONTH(d) AS INT) AS m, CAST(DAY(d) AS INT) AS dd, CAST(ISODOW(d) AS INT) AS dow, CAST(date_diff('day', DATE '1995-01-01', CAST(d AS DATE)) AS INT) AS since, CAST(d + INTERVAL 10 DAY AS DATE) AS plus10, CAST(date_trunc('month', d) AS DATE) AS som, last_day(d) AS eom, strftime(d, '%Y/%m/%d') AS txt, CAST(quarter(d) AS INT) AS q, CAST(dayofyear(d) AS INT) AS doy FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def fn_date(t: Tables):
    d = F.col("o_orderdate")
    day = F.to_date(d)
    return t.orders.select("o_orderkey", rt.year(d).alias("y"), rt.month(d).alias("m"), rt.day_of_month(d).alias("dd"), rt.day_of_week(d).alias("dow"), rt.days_between(F.lit("1995-01-01").cast("date"), day).alias("since"), rt.add_days(day, 10).alias("plus10"), b.start_of_month(d).alias("som"), b.end_of_month(d).alias("eom"), b.date_format(d, "YYYY/MM/DD").alias("txt"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"))


@query("""SELECT event_id, CASE WHEN regexp_full_match(TRIM(s), '[+-]?[0-9]+') THEN CAST(TRIM(s) AS BIGINT) END AS n, LOWER(TRIM(s)) IN ('true', 'yes', '1') AS ok, TRY_CAST(s AS DOUBLE) IS NOT NULL AS num FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'yes' WHEN 2 THEN '3.5' WHEN 3 THEN '1' ELSE 'x' END AS s FROM events)""")
def fn_convert(t: Tables):
    s = F.element_at(F.array(*(F.lit(x) for x in (" 12 ", "yes", "3.5", "1", "x"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", rt.to_long(s).alias("n"), rt.to_boolean(s).alias("ok"), b.is_number(s).alias("num"))


@query("""SELECT c_custkey, COALESCE(v, -1) AS c, NULLIF(c_mktsegment, 'BUILDING') AS n, COALESCE(v BETWEEN 0 AND 5000, FALSE) AS btw, v IS NOT DISTINCT FROM w AS eq, CASE WHEN v IS NOT DISTINCT FROM w THEN 0 WHEN v IS NULL THEN -1 WHEN w IS NULL THEN 1 WHEN v < w THEN -1 ELSE 1 END AS cmp, NOT COALESCE(v IN (1, 2, 3), FALSE) AS nin
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(FLOOR(c_acctbal) AS BIGINT) END AS v, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 1000 END AS w FROM customer)""")
def fn_null(t: Tables):
    v, w = F.when(F.col("c_custkey") % 3 != 0, F.floor("c_acctbal")), F.when(F.col("c_custkey") % 2 != 0, F.lit(1000))
    return t.customer.select("c_custkey", F.coalesce(v, F.lit(-1)).alias("c"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("n"), rt.between(v, 0, 5000).alias("btw"), rt.equals(v, w).alias("eq"), rt.compare(v, w).alias("cmp"), rt.not_member(v, [1, 2, 3]).alias("nin"))


@query("""SELECT o_orderkey, CAST(CASE ISODOW(o_orderdate) WHEN 6 THEN o_orderdate + INTERVAL 2 DAY WHEN 7 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS DATE) AS biz, ISODOW(o_orderdate) < 6 AS is_biz,
(SELECT COUNT(*) FROM generate_series(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY, INTERVAL 1 DAY) g(x) WHERE ISODOW(x) < 6) AS gap FROM orders""")
def fn_bizdays(t: Tables):
    days = dm.calendar(t.spark, "1990-01-01", "2010-12-31")
    o = t.orders.withColumn("later", F.date_add("o_orderdate", 30))
    return dm.business_days_between(o, days, "o_orderdate", "later", "gap").select("o_orderkey", rt.business_date(F.col("o_orderdate")).alias("biz"), rt.is_business_day(F.col("o_orderdate")).alias("is_biz"), F.col("gap").cast("bigint").alias("gap"))


@query("""SELECT c_custkey, ROUND(b * 0.05 * 2, 6) AS simple, ROUND(b * POW(1 + 0.06 / 12, 24) - b, 4) AS compound, ROUND((1000 - b) * 100 / NULLIF(b, 0), 6) AS change, CASE WHEN b <= 0 THEN 0.0 ELSE LEAST(b, GREATEST(b * 0.02, 25.0)) END AS least, ROUND(b * 100 / 10000, 8) AS used FROM (SELECT c_custkey, c_acctbal AS b FROM customer)""")
def fn_percent_interest(t: Tables):
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(b.simple_interest(v, F.lit(0.05), F.lit(2)), 6).alias("simple"), F.round(b.compound_interest(v, F.lit(0.06), F.lit(2), 12), 4).alias("compound"), F.round(b.percent_change(v, F.lit(1000)), 6).alias("change"), finance.minimum_payment(v, 0.02, 25.0, F.lit(0.0), F.lit(0.0)).alias("least"), F.round(finance.utilization(v, F.lit(10000)), 8).alias("used"))


@query("""SELECT vec_id, len(e) AS n, e[1] AS first, e[len(e)] AS last, ROUND(CAST(list_max(e) AS DOUBLE), 5) AS hi, len(list_filter(e, lambda x: x > 0)) AS pos, ROUND(CAST(e[3] AS DOUBLE), 5) AS third, len(list_filter(e, lambda x: x > 10)) > 0 AS anybig FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def fn_array(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.size(e).cast("bigint").alias("n"), b.at(e, 0).alias("first"), F.element_at(e, -1).alias("last"), F.round(F.array_max(e).cast("double"), 5).alias("hi"), b.count_where(e, lambda x: x > 0).cast("bigint").alias("pos"), F.round(b.at(e, 2).cast("double"), 5).alias("third"), b.any_match(e, lambda x: x > 10).alias("anybig"))


_ITEMS = "(SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q, list(l_linenumber ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1)"


def _items(t: Tables):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    return t.lineitem.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["l_quantity"]).alias("q"), F.transform("r", lambda x: x["l_linenumber"]).alias("n"))


@query(f"""SELECT l_orderkey, len(list_filter(q, lambda x: x > 45)) > 0 AS has, len(list_filter(q, lambda x: x <= 2)) = 0 AS none, len(list_filter(q, lambda x: x > 10)) = len(q) AS every FROM {_ITEMS}""")
def coll_any_all_none(t: Tables):
    q = F.col("q")
    return _items(t).select("l_orderkey", b.any_match(q, lambda x: x > 45).alias("has"), b.none_match(q, lambda x: x <= 2).alias("none"), b.all_match(q, lambda x: x > 10).alias("every"))


@query(f"""SELECT l_orderkey, ROUND(COALESCE(list_sum(f), 0), 4) AS s, ROUND(COALESCE(list_avg(f), 0), 6) AS a, f[1] AS found FROM (SELECT l_orderkey, list_filter(q, lambda x: x > 20) AS f FROM {_ITEMS})""")
def coll_sum_avg(t: Tables):
    f = F.filter("q", lambda x: x > 20)
    return _items(t).select("l_orderkey", F.round(b.list_sum(f), 4).alias("s"), F.round(b.list_avg(f), 6).alias("a"), b.find(F.col("q"), lambda x: x > 20).alias("found"))


@query(f"""SELECT l_orderkey, array_to_string(list_reverse_sort(n), ',') AS d, array_to_string(n[1:2], ',') AS t2, array_to_string(n[3:], ',') AS rest, len(list_distinct(q)) AS dist, COALESCE(CAST(list_position(n, 3) AS INT), 0) - 1 AS idx, len(list_filter(n, lambda x: x % 2 = 0)) AS evens FROM {_ITEMS}""")
def fn_list(t: Tables):
    n = F.col("n")
    text = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return _items(t).select("l_orderkey", text(b.sort_by(n, lambda x: x, descending=True)).alias("d"), text(b.take(n, 2)).alias("t2"), text(b.skip(n, 2)).alias("rest"), F.size(F.array_distinct("q")).cast("bigint").alias("dist"), b.index_in(n, 3).alias("idx"), F.size(b.partition(n, lambda x: x % 2 == 0)["yes"]).cast("bigint").alias("evens"))


@query("""SELECT p_partkey, p_brand AS brand, COALESCE(CASE WHEN p_size > 20 THEN 'big' END, 'n/a') AS label, CAST(CASE WHEN p_size > 20 THEN 3 ELSE 2 END AS BIGINT) AS n FROM part""")
def fn_map(t: Tables):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    m = F.when(F.col("p_size") > 20, b.map_put(m, "size", "big")).otherwise(m)
    return t.part.select("p_partkey", m["brand"].alias("brand"), b.map_get_or(m, "size", "n/a").alias("label"), F.size(m).cast("bigint").alias("n"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1 FROM events""")
def fn_json(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.from_json("props", "k bigint")["k"] + 1).alias("k1"))


@query("""SELECT p_partkey, p_brand AS brand, p_size + 1 AS size, p_type AS kind FROM part""")
def fn_struct(t: Tables):
    r = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    r = b.record_set(b.record_set(r, "size", r["size"] + 1), "kind", F.col("p_type"))
    return t.part.select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("""SELECT c_custkey, sha256('salt' || c_name) AS h, SUBSTRING(c_name, 1, 1) || '**-' || SUBSTRING(c_name, 4, 1) AS masked FROM customer""")
def hash_mask(t: Tables):
    return t.customer.select("c_custkey", rt.salted_hash(F.col("c_name"), "salt").alias("h"), rt.mask(F.col("c_name"), "#**-#").alias("masked"))


@query("""SELECT c_custkey, list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END FOR d, i IN digits]) % 10 = 0 AS luhn, LEFT(pan, 6) || repeat('*', 6) || RIGHT(pan, 4) AS masked
FROM (SELECT c_custkey, pan, [CAST(x AS INT) FOR x IN string_split(reverse(pan), '')] AS digits FROM (SELECT c_custkey, '4' || LPAD(CAST((c_custkey * 7919 + 13) % 1000000000 AS VARCHAR), 15, '0') AS pan FROM customer))""")
def domain_luhn(t: Tables):
    pan = F.concat(F.lit("4"), F.lpad(((F.col("c_custkey") * 7919 + 13) % 1000000000).cast("string"), 15, "0"))
    return t.customer.select("c_custkey", cards.luhn_validate(pan).alias("luhn"), cards.mask_pan(pan).alias("masked"))


@query("""SELECT s_suppkey, ROUND(2 * 6371.0 * ASIN(SQRT(POW(SIN(RADIANS(lat - 50) / 2), 2) + COS(RADIANS(50)) * COS(RADIANS(lat)) * POW(SIN(RADIANS(lon - 8) / 2), 2))), 5) AS km FROM (SELECT s_suppkey, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier)""")
def domain_haversine(t: Tables):
    lat, lon = (F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 180).cast("double")
    return t.supplier.select("s_suppkey", F.round(dm.haversine_km(F.lit(50.0), F.lit(8.0), lat, lon), 5).alias("km"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'visa' WHEN c_custkey % 4 = 1 THEN 'mastercard' WHEN c_custkey % 4 = 2 THEN 'amex' END AS network, ROUND((LEAST(GREATEST(c_acctbal / 100, 0.0), 100.0) * 0.5 + c_custkey % 50 * 0.5), 6) AS score,
CASE WHEN LEAST(GREATEST(c_acctbal / 100, 0.0), 100.0) * 0.5 + c_custkey % 50 * 0.5 <= 30 THEN 'low' WHEN LEAST(GREATEST(c_acctbal / 100, 0.0), 100.0) * 0.5 + c_custkey % 50 * 0.5 <= 60 THEN 'medium' WHEN LEAST(GREATEST(c_acctbal / 100, 0.0), 100.0) * 0.5 + c_custkey % 50 * 0.5 <= 80 THEN 'high' ELSE 'critical' END AS level FROM customer""")
def domain_network_score(t: Tables):
    pan = F.element_at(F.array(*(F.lit(x) for x in ("4532015112830366", "5500005555555559", "371449635398431", "9000"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    score = risk.weighted_score([risk.normalize_score(F.col("c_acctbal"), 0, 10000), F.col("c_custkey") % 50], [0.5, 0.5])
    return t.customer.select("c_custkey", cards.identify_card_network(pan).alias("network"), F.round(score, 6).alias("score"), risk.risk_level(score).alias("level"))


@query("""SELECT c_custkey, ROUND(c_acctbal * 0.18 / 365 * 30, 8) AS interest, CASE WHEN c_acctbal * 0.05 < 10 THEN 10.0 WHEN c_acctbal * 0.05 > 50 THEN 50.0 ELSE c_acctbal * 0.05 END AS fee,
CASE WHEN c_acctbal / 100 <= 10 THEN 'excellent' WHEN c_acctbal / 100 <= 30 THEN 'good' WHEN c_acctbal / 100 <= 50 THEN 'fair' WHEN c_acctbal / 100 <= 75 THEN 'high' WHEN c_acctbal / 100 <= 100 THEN 'critical' ELSE 'overlimit' END AS tier,
CAST(ROUND(c_acctbal * 100) AS BIGINT) AS cents FROM customer""")
def domain_finance(t: Tables):
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(finance.interest_for_period(v, F.lit(0.18), F.lit(30)), 8).alias("interest"), finance.cash_advance_fee(v, 0.05, 10, 50).alias("fee"), finance.utilization_tier(finance.utilization(v, F.lit(10000))).alias("tier"), finance.minor_units(v, F.lit("USD")).alias("cents"))


@query("""WITH g AS (SELECT event_id, value, ts, LAG(value) OVER w AS pv, epoch(ts) - epoch(LAG(ts) OVER w) AS secs FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN pv IS NULL THEN NULL WHEN ABS(value - pv) * 100 > secs / 3600 * 1000 THEN 'impossible' WHEN ABS(value - pv) * 100 > secs / 3600 * 500 THEN 'highly_suspicious' WHEN ABS(value - pv) * 100 > secs / 3600 * 200 THEN 'suspicious' ELSE 'possible' END AS travel,
ISODOW(ts) >= 6 AS weekend, hour(ts) BETWEEN 2 AND 5 AS odd FROM g""")
def domain_risk(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    km = F.abs(F.col("value") - F.lag("value").over(w)) * 100
    hours = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 1e6 / 3600
    return t.events.select("event_id", risk.travel_verdict(km, hours).alias("travel"), risk.is_weekend(at).alias("weekend"), risk.is_odd_hours(at, 2, 5).alias("odd"))
