"""Scans, predicates, joins and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.operators.windows import latest
from tidemark.plans.base import query, r


@query("""SELECT o_orderkey AS id, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS label, round(o_totalprice / 100.0, 6) AS price,
 FALSE AS derived, upper(substr(o_orderpriority, 3)) AS priority, CAST(o_orderdate AS DATE) AS day FROM orders
 WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority LIKE '%-%' AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('O', 'P')""", dates="day")
def scan_project(t):
    o = t.orders.where(~F.col("o_orderstatus").eqNullSafe("F") & F.col("o_orderpriority").contains("-") & F.col("o_totalprice").between(1000, 300000) & F.col("o_orderstatus").isin("O", "P"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")).alias("label"), r(F.col("o_totalprice") / 100).alias("price"),
                    F.lit(False).alias("derived"), F.upper(F.substring("o_orderpriority", 3, 100)).alias("priority"), F.to_date("o_orderdate").alias("day"))


@query("SELECT event_id, value FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7")
def recency_filter(t):
    from tidemark.readside import last_days

    return last_days(t.events.withColumn("day", F.to_date("ts")), "day", 7).select("event_id", "value")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band,
 CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, regexp_matches(c_name, '[05]$') AS round_name, ends_with(c_name, '7') AS seventh FROM customer""")
def case_ladder(t):
    c = F.col("c_acctbal")
    band = F.when(c < 0, "owing").when(c < 1000, "low").when(c < 5000, "mid").otherwise("high")
    return t.customer.select("c_custkey", band.alias("band"), F.when(c > 0, c).alias("positive"), F.col("c_name").rlike("[05]$").alias("round_name"), F.col("c_name").endswith("7").alias("seventh"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_anti(t):
    c = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    c = joins.not_in(c, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    return c.select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_discount > 0.0999) OR FALSE")
def tuple_not_in(t):
    return joins.not_in(t.lineitem, t.lineitem.where("l_discount > 0.0999"), "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber")


@query("""SELECT n_name, r_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def multi_join(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT p.event_id, p.user_id, CASE WHEN date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE)) <= 5 THEN s.value END AS rate,
 CASE WHEN date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE)) <= 5 THEN round(p.value * s.value, 6) END AS converted
 FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_fx(t):
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    s = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("rate_ts"), F.col("value").alias("rate"))
    out = joins.asof_join(p, s, "ts", "rate_ts", "user_id", max_age=5)
    return out.select("event_id", "user_id", "rate", r(F.col("value") * F.col("rate")).alias("converted"))


@query("""SELECT o.o_orderkey, e.o_orderkey AS held FROM orders o ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2) e ON o.o_custkey = e.o_custkey AND o.o_orderdate > e.o_orderdate""")
def asof_strict_inner(t):
    e = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("u_date"), F.col("o_orderkey").alias("held"))
    return joins.asof_join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), e, "o_orderdate", "u_date", "o_custkey", strict=True, inner=True).select("o_orderkey", "held")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1), q AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT month, day, round(v, 2) AS v FROM q ASOF LEFT JOIN d ON month >= day""", dates="month day")
def asof_without_key(t):
    d = t.orders.where("o_orderpriority = '5-LOW'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    q = t.orders.select(F.to_date(F.trunc("o_orderdate", "month")).alias("month")).distinct()
    return joins.asof_join(q, d, "month", "day")


@query("""SELECT o_orderkey, next_date, next_price FROM (SELECT a.o_orderkey, CAST(b.o_orderdate AS DATE) AS next_date, b.o_totalprice AS next_price, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_totalprice DESC) AS rn
 FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) > CAST(a.o_orderdate AS DATE) AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 90) WHERE rn = 1""", dates="next_date")
def forward_window_first(t):
    o = t.orders.withColumn("d", F.to_date("o_orderdate"))
    return joins.forward_window_first(o.select("o_orderkey", "o_custkey", "d"), o.select("o_custkey", F.col("d").alias("next_date"), F.col("o_totalprice").alias("next_price")), "o_custkey", "d", "next_date", 90).select("o_orderkey", "next_date", "next_price")


@query("""WITH u AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS p FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT o_orderkey, near, p FROM (SELECT o.o_orderkey, u.d AS near, u.p, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(date_diff('day', u.d, CAST(o.o_orderdate AS DATE))), u.d) AS rn
 FROM (SELECT * FROM orders WHERE o_orderpriority = '5-LOW') o LEFT JOIN u ON o.o_custkey = u.o_custkey AND abs(date_diff('day', u.d, CAST(o.o_orderdate AS DATE))) <= 45) WHERE rn = 1""", dates="near")
def nearest_45d(t):
    o = t.orders.withColumn("d", F.to_date("o_orderdate"))
    u = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("d").alias("near"), F.col("o_totalprice").alias("p"))
    return joins.nearest_join(o.where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_custkey", "d"), u, "o_custkey", "d", "near", 45, ["p"]).select("o_orderkey", "near", "p")


@query("""SELECT l_orderkey, l_linenumber, s.o_orderkey AS span FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
 JOIN (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b FROM orders WHERE o_orderpriority = '2-HIGH') s ON s.o_custkey = o.o_custkey AND CAST(l_shipdate AS DATE) BETWEEN s.a AND s.b""")
def interval_containment(t):
    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", F.to_date("l_shipdate").alias("ship"))
    s = t.orders.where("o_orderpriority = '2-HIGH'").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 30).alias("b"), F.col("o_orderkey").alias("span"))
    return joins.interval_join(l, s, "o_custkey", "ship", "a", "b").select("l_orderkey", "l_linenumber", "span")


@query("""WITH q AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.q, a.v, b.v AS prev, round(a.v / nullif(b.v, 0) - 1, 6) AS change FROM q a LEFT JOIN q b ON a.o_custkey = b.o_custkey AND b.q = a.q - INTERVAL 3 MONTH""", dates="q")
def previous_period(t):
    q = t.orders.groupBy("o_custkey", F.to_date(F.trunc("o_orderdate", "quarter")).alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    b = q.select("o_custkey", F.add_months("q", 3).alias("q"), F.col("v").alias("prev"))
    return q.join(b, ["o_custkey", "q"], "left").select("o_custkey", "q", "v", "prev", r(F.try_divide("v", "prev") - 1).alias("change"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_orderkey, max(CAST(e.ts AS DATE)) AS inside FROM s LEFT JOIN events e ON e.user_id = s.o_custkey AND e.event_type = 'error' AND CAST(e.ts AS DATE) > CAST(p AS DATE) AND CAST(e.ts AS DATE) < CAST(o_orderdate AS DATE) GROUP BY 1""", dates="inside")
def last_event_between(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), F.to_date(F.lag("o_orderdate").over(w)).alias("p"))
    e = t.events.where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"), F.to_date("ts").alias("inside")).distinct()
    return joins.asof_join(s, e, "d", "inside", "o_custkey", strict=True).select("o_orderkey", F.when(F.col("inside") > F.col("p"), F.col("inside")).alias("inside"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS ws FROM part), names AS (SELECT DISTINCT list_aggregate(ws[1:2], 'string_agg', ' ') AS name FROM w UNION SELECT DISTINCT ws[1] FROM w)
SELECT p_partkey, arg_max(name, length(name)) AS matched_prefix FROM w JOIN names ON list_aggregate(ws, 'string_agg', ' ') = name OR starts_with(list_aggregate(ws, 'string_agg', ' '), name || ' ') GROUP BY 1""")
def longest_prefix(t):
    ws = F.split("p_type", " ")
    names = t.part.select(F.array_join(F.slice(ws, 1, 2), " ").alias("name")).union(t.part.select(ws[0].alias("name"))).distinct()
    return joins.longest_prefix_join(t.part.select("p_partkey", "p_type"), names, "p_type", "name", []).select("p_partkey", "matched_prefix")


@query("""SELECT user_id, bool_or(abs(b.value / nullif(a.value, 0) - 1) > 0.0001) AS changed FROM (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) a
 JOIN (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b USING (user_id, d) GROUP BY 1""")
def overlap_restated(t):
    from tidemark.domain.fx import restated

    e = lambda k: t.events.where(F.col("event_type") == k).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("value").alias("value"))
    return restated(e("click"), e("view"), "user_id", "d", "value", "9999-01-01")


@query("SELECT n_nationkey AS k, 'nation' AS src FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(t):
    return t.nation.select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("src")).unionByName(t.region.select(F.col("r_regionkey").alias("k"), F.lit("region").alias("src"))).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""WITH y AS (SELECT s_suppkey % 7 AS k, year(l_shipdate)::INT AS y, list_sort(list(DISTINCT l_partkey % 50)) AS items FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT k, y, len(list_filter(items, lambda x: NOT list_contains(coalesce(p, []), x)))::INT AS added, len(list_filter(coalesce(p, []), lambda x: NOT list_contains(items, x)))::INT AS removed, len(list_filter(items, lambda x: list_contains(coalesce(p, []), x)))::INT AS kept
 FROM (SELECT k, y, items, lag(items) OVER (PARTITION BY k ORDER BY y) AS p FROM y)""")
def set_changes(t):
    from tidemark.domain.documents import list_changes

    x = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy((F.col("s_suppkey") % 7).alias("k"), F.year("l_shipdate").alias("y")).agg(F.sort_array(F.collect_set(F.col("l_partkey") % 50)).alias("items"))
    added = F.size(F.coalesce("added", "items"))  # a first year has nothing before it
    changes = list_changes(x, "k", "y", "items")
    return changes.select("k", "y", added.alias("added"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed"), (F.size("items") - added).alias("kept"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_except(t):
    s = lambda k: t.orders.where(F.col("o_orderstatus") == k).select("o_custkey")
    return s("O").intersect(s("F")).subtract(s("P"))


@query("SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS flag FROM lineitem WHERE l_quantity > 49")
def explode_lateral(t):
    return t.lineitem.where("l_quantity > 49").select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("flag"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def topk_per_group(t):
    return latest(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 8")
def topk_global(t):
    return t.part.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(8).select("p_partkey", "p_retailprice")


@query("""SELECT p_name, tier FROM (SELECT DISTINCT p_name, CASE WHEN lower(p_name) = 'part 1' THEN 0 WHEN starts_with(lower(p_name), 'part') THEN 1 WHEN contains(lower(p_name), 'a') THEN 2 ELSE 3 END AS tier FROM part) ORDER BY tier, length(p_name), p_name LIMIT 8""")
def ranked_search(t):
    n = F.lower("p_name")
    tier = F.when(n == "part 1", 0).when(n.startswith("part"), 1).when(n.contains("a"), 2).otherwise(3)
    return t.part.select("p_name", tier.alias("tier")).distinct().orderBy("tier", F.length("p_name"), "p_name").limit(8)
