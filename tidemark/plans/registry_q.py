"""Registry queries on the driver's tables: identifiers, currencies, countries, corrections, the load log."""

from pyspark.sql import functions as F

from tidemark.domain import registry
from tidemark.plans.base import query


@query("""WITH c AS (SELECT c_custkey AS k, 'T' || c_nationkey AS ticker, lower(c_mktsegment) AS norm FROM customer), o AS (SELECT o_custkey AS k, min(o_orderkey) AS cik FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
t AS (SELECT 'T' || s_nationkey AS ticker, min(s_suppkey) AS cik FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), m AS (SELECT lower(c_mktsegment) AS norm, min(c_nationkey) AS cik, count(DISTINCT c_nationkey) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
 UNION ALL SELECT 'building', 7, 1)
SELECT c.k, coalesce(o.cik, t.cik, CASE WHEN n = 1 THEN m.cik END) AS cik, CASE WHEN o.cik IS NOT NULL THEN 'override' WHEN t.cik IS NOT NULL THEN 'ticker' WHEN n = 1 THEN 'name' ELSE 'review' END AS method
 FROM c LEFT JOIN o ON c.k = o.k LEFT JOIN t ON c.ticker = t.ticker LEFT JOIN m ON c.norm = m.norm""")
def resolve_ids(t):
    tick = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    c = t.customer.select(F.col("c_custkey").alias("k"), tick("c_nationkey").alias("ticker"), F.lower("c_mktsegment").alias("norm"))
    o = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("cik"))
    by_ticker = t.supplier.where("s_acctbal > 5000").select(tick("s_nationkey").alias("ticker"), F.col("s_suppkey").alias("cik"))
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(7)).otherwise(F.col("c_nationkey")).cast("long")
    names = t.customer.select(F.lower("c_mktsegment").alias("norm"), key.alias("cik"))
    return registry.resolve_ids(c, o, by_ticker, names, "k").select("k", "cik", "method")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'CHF' WHEN user_id % 3 = 0 THEN 'SEK' WHEN user_id % 5 = 0 THEN 'JPY' WHEN user_id % 7 = 0 THEN 'NOK' END AS currency FROM events""")
def filled_currency(t):
    u = F.col("user_id")
    ticker = F.when(u % 5 == 0, F.concat(F.lit("EURJPY=X"))).otherwise(F.concat(F.lit("U"), u.cast("string")))
    ticker = F.when(u % 3 == 0, F.concat(F.lit("U"), u.cast("string"))).otherwise(ticker)
    p = t.events.select("event_id", ticker.alias("ticker"), F.when(u % 2 == 0, F.lit("CHF")).alias("currency"))
    known = t.events.select("user_id").distinct().withColumn("ticker", F.concat(F.lit("U"), u.cast("string")))
    overrides = known.where("user_id % 3 = 0").select("ticker", F.lit("SEK").alias("currency"))
    metadata = known.where("user_id % 7 = 0").select("ticker", F.lit("NOK").alias("currency"))
    return registry.fill_currency(p, overrides, metadata).select("event_id", "currency")


@query("""SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' END AS country, strftime(to_timestamp(s_suppkey * 86400 * 17), '%m%d') AS fye FROM supplier""")
def exchange_countries(t):
    suffix = F.element_at(F.array(F.lit(""), F.lit(".L"), F.lit(".de"), F.lit(".ZZ")), (F.col("s_nationkey") % 4 + 1).cast("int"))
    s = t.supplier.withColumn("ticker", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), suffix)).withColumn("seconds", F.col("s_suppkey") * 86400 * 17)
    return s.select("s_suppkey", registry.exchange_country("ticker").alias("country"), registry.fiscal_year_end("seconds").alias("fye"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'New#11' WHEN 'Brand#12' THEN 'New#12' ELSE p_brand END AS ticker FROM part")
def renamed_tickers(t):
    changes = t.spark.createDataFrame([("Brand#11", "New#11"), ("Brand#12", "New#12")], "old string, new string")
    return registry.rename_tickers(t.part.select("p_partkey", F.col("p_brand").alias("ticker")), changes)


@query("""SELECT event_type AS step, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS finished_at, count(*)::BIGINT AS items, sum(user_id)::BIGINT AS rows,
 count(*) FILTER (WHERE value > 100)::BIGINT AS n_failed, coalesce(array_to_string(list_sort(list(event_id) FILTER (WHERE value > 100)), ';'), '') AS failed, CAST(CAST(ts AS DATE) AS VARCHAR) AS run FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def load_log(t):
    steps = t.events.select(F.col("event_type").alias("step"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_id").alias("item"), (F.col("value") <= 100).alias("ok"), F.col("user_id").alias("rows"), F.col("ts").alias("at"))
    out = registry.load_log(steps)
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("step", "run", moment("started_at"), moment("finished_at"), "items", "rows", "n_failed", F.array_join(F.transform("failed_items", lambda x: x.cast("string")), ";").alias("failed"))
