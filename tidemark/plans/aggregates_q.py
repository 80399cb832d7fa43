"""Aggregates, resampling, pivots and window functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import semantics as sem
from tidemark.operators import aggregate, upsert, windows
from tidemark.plans.base import BARS, RETURNS, bars, query, r, returns


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers, count(*) FILTER (WHERE o_totalprice > 250000)::BIGINT AS big, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS last_f,
 bool_or(o_totalprice > 499000) AS any_huge, arg_max(o_orderkey, (o_totalprice, o_orderkey))::BIGINT AS top_order, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1000 ELSE o_totalprice END), 2) AS switched FROM orders GROUP BY ALL""", dates="last_f")
def filtered_aggregates(t):
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(p > 250000).alias("big"), F.max(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))).alias("last_f"),
        F.bool_or(p > 499000).alias("any_huge"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", p * 1000).otherwise(p)), 2).alias("switched"))


@query("""WITH q AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, q, CASE WHEN count(v) OVER w = 4 THEN round(sum(v) OVER w, 2) END AS ttm FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", dates="q")
def ttm_sum(t):
    q = t.orders.groupBy("o_custkey", F.to_date(F.trunc("o_orderdate", "quarter")).alias("q")).agg(F.sum("o_totalprice").alias("v"))
    return q.select("o_custkey", "q", F.round(sem.rolling("v", 4, F.sum, "o_custkey", "q"), 2).alias("ttm"))


@query("""SELECT event_type, round(skewness(value), 6) AS skew_g1, round(kurtosis(value), 6) AS kurt_g2, round(kurtosis_pop(value), 6) AS kurt_pop, round(median(value), 6) AS med, round(quantile_cont(value, 0.05), 6) AS q05,
 round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(corr(value, event_id), 6) AS c FROM events GROUP BY 1""")
def moments(t):
    return t.events.groupBy("event_type").agg(r(sem.skew_sample("value")).alias("skew_g1"), r(sem.kurt_sample("value")).alias("kurt_g2"), r(sem.kurt_pop("value")).alias("kurt_pop"), r(F.median("value")).alias("med"),
                                             r(sem.quantile("value", 0.05)).alias("q05"), r(F.stddev_samp("value")).alias("sd"), r(F.stddev_pop("value")).alias("sd_pop"), r(F.corr("value", "event_id")).alias("c"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ';') AS keys, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 480000 GROUP BY 1")
def group_to_list(t):
    return t.orders.where("o_totalprice > 480000").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";").alias("keys"), F.count("*").alias("n"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 30 MINUTE), '%Y-%m-%d %H:%M') AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
 sum(user_id)::BIGINT AS volume, count(*)::BIGINT AS n, round(CASE WHEN sum(user_id) > 0 THEN sum(value * user_id) / sum(user_id) ELSE avg(value) END, 6) AS vwap FROM events GROUP BY 1, 2""")
def resample_bars(t):
    b = aggregate.bars(t.events, "event_type", "ts", "value", "user_id", "1 hour", "30 minutes", tie="event_id")
    return b.select("event_type", F.date_format("bar", "yyyy-MM-dd HH:mm").alias("bar"), "open", "high", "low", "close", "volume", "n", r("vwap").alias("vwap"))


@query(f"WITH {RETURNS} SELECT ticker, CAST(date_trunc('year', date) AS DATE) AS period, round(exp(sum(r)) - 1, 6) AS ret FROM ret GROUP BY 1, 2", dates="period")
def calendar_returns(t):
    from tidemark.metrics import period_returns

    return period_returns(returns(t), "ticker", "date", "r", "year").select("ticker", "period", r("ret").alias("ret"))


@query("SELECT " + ", ".join(["y AS year"] + [f"round(sum(v) FILTER (WHERE m = {i}), 2) AS m{i}" for i in range(1, 13)]) + " FROM (SELECT year(o_orderdate)::INT AS y, month(o_orderdate) AS m, o_totalprice AS v FROM orders) GROUP BY y")
def month_pivot(t):
    p = t.orders.withColumn("m", F.month("o_orderdate")).withColumn("year", F.year("o_orderdate")).groupBy("year").pivot("m", list(range(1, 13))).agg(F.round(F.sum("o_totalprice"), 2))
    return p.select("year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


@query("SELECT s_suppkey, item, value FROM (SELECT s_suppkey, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) UNPIVOT (value FOR item IN (balance, nation))")
def unpivot_items(t):
    return t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")).unpivot(["s_suppkey"], ["balance", "nation"], "item", "value")


@query("""SELECT * FROM (PIVOT (SELECT 'y' || CAST(y AS VARCHAR) AS period, item, round(v, 2) AS v FROM (SELECT year(o_orderdate) AS y, 'total' AS item, sum(o_totalprice) AS v FROM orders GROUP BY 1
 UNION ALL SELECT year(o_orderdate), 'largest', max(o_totalprice) FROM orders GROUP BY 1)) ON period USING max(v) GROUP BY item)""")
def statement_table(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest"), F.lit(None).cast("double").alias("nothing"))
    years = [x.y for x in y.select("y").distinct().orderBy("y").collect()]  # one a year of the calendar
    out = aggregate.transpose(y, "y", ["total", "largest", "nothing"], years)
    return out.select("item", *[F.round(str(x), 2).alias(f"y{x}") for x in years])


@query(f"WITH {RETURNS} SELECT a.ticker AS a, b.ticker AS b, round(corr(a.r, b.r), 6) AS corr, round(covar_samp(a.r, b.r), 6) AS cov, count(*)::BIGINT AS n FROM ret a JOIN ret b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2")
def corr_matrix(t):
    return aggregate.pair_stats(returns(t), "ticker", "date", "r").select("a", "b", r("corr").alias("corr"), r("cov").alias("cov"), "n")


@query("SELECT p_partkey, round((p_size + p_retailprice) / 2.0, 6) AS mean2, (CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END + CASE WHEN contains(p_brand, '1') THEN 1 ELSE 0 END)::INT AS score, greatest(CAST(p_size AS DOUBLE), p_retailprice / 50) AS top FROM part")
def row_wise(t):
    flag = lambda c: F.when(c, 1).otherwise(0)
    return t.part.select("p_partkey", r(sem.row_mean("p_size", "p_retailprice")).alias("mean2"), (flag(F.col("p_size") > 25) + flag(F.col("p_retailprice") > 1000) + flag(F.col("p_brand").contains("1"))).alias("score"), F.greatest(F.col("p_size").cast("double"), F.col("p_retailprice") / 50).alias("top"))


@query("SELECT CASE WHEN rn <= 3 THEN n_name ELSE 'Other' END AS n_name, sum(n)::BIGINT AS n FROM (SELECT n_name, n, row_number() OVER (ORDER BY n DESC, n_name) AS rn FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)) GROUP BY 1")
def top3_and_other(t):
    return aggregate.top_and_other(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", 3)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(t):
    return windows.latest(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders QUALIFY year(o_orderdate) > max(year(o_orderdate)) OVER (PARTITION BY o_custkey) - 2")
def last_years(t):
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", "o_custkey", y.alias("y")).withColumn("m", F.max("y").over(Window.partitionBy("o_custkey"))).where("y > m - 2").select("o_orderkey", "y")


@query("""SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS diff, round(o_totalprice / nullif(lag(o_totalprice) OVER w, 0) - 1, 6) AS pct, lead(o_orderkey, 2) OVER w AS ahead, row_number() OVER w - 1 AS cumcount
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("diff"), r(sem.pct_change("o_totalprice", w)).alias("pct"), F.lead("o_orderkey", 2).over(w).alias("ahead"), (F.row_number().over(w) - 1).alias("cumcount"))


@query(f"WITH {BARS} SELECT ticker, date, round(coalesce(exp(sum(ln(1 + volume / 1000000)) OVER (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0), 6) AS f FROM bars", dates="date")
def suffix_product(t):
    return bars(t).select("ticker", "date", r(windows.suffix_product(1 + F.col("volume") / 1000000, "ticker", "date")).alias("f"))


@query(f"""WITH {BARS} SELECT ticker, date, round(CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END, 6) AS mean20, round(CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END, 6) AS sd20,
 round(CASE WHEN count(close) OVER w >= 10 THEN max(close) OVER w END, 6) AS max20, round(CASE WHEN count(close) OVER m >= 5 THEN quantile_cont(close, 0.5) OVER m END, 9) AS med5
 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), m AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", dates="date")
def rolling_stats(t):
    b, roll = bars(t), lambda n, fn, least=None: sem.rolling("close", n, fn, "ticker", "date", least)
    m = Window.partitionBy("ticker").orderBy("date").rowsBetween(-2, 2)
    return b.select("ticker", "date", r(roll(20, F.avg)).alias("mean20"), r(roll(20, F.stddev_samp)).alias("sd20"), r(roll(20, F.max, 10)).alias("max20"), r(sem.guarded(F.percentile("close", F.lit(0.5)), "close", m, 5), 9).alias("med5"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, close, avg(close) OVER w AS m, list(close) OVER w AS l, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, date, CASE WHEN n = 20 THEN round(list_avg(list_transform(l, lambda v: abs(v - m))), 6) END AS mad20 FROM x""", dates="date")
def rolling_deviation(t):
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
    m = F.avg("close").over(w)
    dev = F.aggregate(F.collect_list("close").over(w), F.lit(0.0), lambda s, x: s + F.abs(x - m)) / F.count("*").over(w)
    return bars(t).select("ticker", "date", F.when(F.count("*").over(w) == 20, r(dev)).alias("mad20"))


@query(f"WITH {RETURNS} SELECT ticker, date, round(stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS sd FROM ret", dates="date")
def expanding_std(t):
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return returns(t).select("ticker", "date", r(F.stddev_samp("r").over(w)).alias("sd"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type, sum(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT event_type, g.d::DATE AS d FROM events, (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events) g),
j AS (SELECT s.event_type, s.d, CASE WHEN day(s.d) % 4 = 0 THEN v END AS v FROM s LEFT JOIN d ON s.d = d.d AND s.event_type = d.event_type)
SELECT event_type, d, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ff, round(first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS bf,
 round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY d RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS ff_days FROM j""", dates="d")
def fills(t):
    d = t.events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.sum("value").alias("v"))
    span = d.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    s = t.events.select("event_type").distinct().crossJoin(F.broadcast(span))
    j = s.join(d, ["event_type", "d"], "left").withColumn("v", F.when(F.dayofmonth("d") % 4 == 0, F.col("v")))
    return j.select("event_type", "d", F.round(windows.ffill("v", "event_type", "d", 2), 4).alias("ff"), F.round(windows.bfill("v", "event_type", "d"), 4).alias("bf"), F.round(windows.ffill_days("v", "event_type", "d", 1), 4).alias("ff_days"))


@query("""SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS avg_rank,
 round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY p_brand) - 1), 6) AS unit_rank, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS min_rank FROM part""")
def feature_rank(t):
    return t.part.select("p_partkey", sem.avg_rank("p_size", "p_brand").alias("avg_rank"), r(sem.unit_rank("p_size", "p_brand")).alias("unit_rank"), F.rank().over(Window.partitionBy("p_brand").orderBy("p_size")).alias("min_rank"))


@query("""WITH m AS (SELECT c_mktsegment AS run, year(o_orderdate) AS period, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT run, period::INT AS period, round((v - avg(v) OVER p) / stddev_samp(v) OVER p, 6) AS z, (rank() OVER (PARTITION BY period ORDER BY v) - 1)::INT AS borda, round(v - avg(v) OVER p, 4) AS demeaned FROM m WINDOW p AS (PARTITION BY period)""")
def zscore_borda(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("run"), F.year("o_orderdate").alias("period")).agg(F.avg("o_totalprice").alias("v"))
    return m.select("run", "period", r(sem.zscore("v", "period")).alias("z"), (F.rank().over(Window.partitionBy("period").orderBy("v")) - 1).alias("borda"), F.round(sem.demean("v", "period"), 4).alias("demeaned"))


@query(f"""WITH {RETURNS}, s AS (SELECT ticker, date, sign(r) AS s, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, sign(r) ORDER BY date) AS g FROM ret),
n AS (SELECT ticker, s, g, count(*) AS n FROM s GROUP BY ALL) SELECT ticker, coalesce(max(n) FILTER (WHERE s > 0), 0)::BIGINT AS longest_win, coalesce(max(n) FILTER (WHERE s < 0), 0)::BIGINT AS longest_loss FROM n GROUP BY 1""")
def streaks(t):
    from tidemark.metrics import streaks as run

    return run(returns(t), "ticker", "date", "r")


@query("SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)", dates="first_day")
def first_per_month(t):
    return t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.min(F.to_date("o_orderdate")).alias("first_day")).drop("m")


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 2000 THEN 0.5 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier UNION ALL SELECT CAST(-r_regionkey - 1 AS BIGINT), NULL, 0.5, NULL FROM region")
def upsert_partial(t):
    inc = t.supplier.where("s_acctbal < 2000").select("s_suppkey").union(t.region.select((-F.col("r_regionkey") - 1).cast("long"))).withColumn("s_acctbal", F.lit(0.5))
    twice = inc.withColumn("o", F.lit(2)).union(inc.select("s_suppkey", F.lit(9.5), F.lit(1)))
    return upsert.upsert(t.supplier, twice.select("s_suppkey", "s_acctbal", "o"), "s_suppkey", "o").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")


@query("""WITH l AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, sha256(props) AS hash, 2 AS version FROM (SELECT user_id, props, rn, p FROM l WHERE rn = 2) WHERE sha256(props) <> p UNION ALL SELECT user_id, sha256(props), 1 FROM l WHERE rn = 1""")
def versioning_hash(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "props", F.row_number().over(w).alias("rn"))
    first = e.where("rn = 1").select("user_id", F.lit(1).alias("version"), F.sha2("props", 256).alias("hash"))
    second = upsert.next_versions(first, e.where("rn = 2"), "user_id", "props").select("user_id", "hash", "version")
    return second.unionByName(first.select("user_id", "hash", "version"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def ledger_skip(t):
    return upsert.unprocessed(t.orders, t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("SELECT user_id, CAST(count(*) AS VARCHAR) || '|' || CAST(max(event_id) AS VARCHAR) AS fingerprint FROM events GROUP BY 1")
def facts_fingerprint(t):
    return upsert.fingerprint(t.events, "user_id", "event_id")


@query("""WITH y AS (SELECT s_nationkey AS k, year(l_shipdate)::INT AS y, round(sum(CASE WHEN year(l_shipdate) % 2 = 0 THEN l_quantity END), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT k, y, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM y""")
def carry_forward(t):
    y = F.year("l_shipdate")
    x = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("k"), y.alias("y")).agg(F.when(y % 2 == 0, F.round(F.sum("l_quantity"), 2)).alias("v"))
    return upsert.carry_forward(x, "k", "y", "v", F.lit(True))


@query("SELECT event_type, k, n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)")
def json_paths(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 10
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT y, phase, count(DISTINCT l_orderkey)::BIGINT AS n FROM (SELECT year(l_shipdate)::INT AS y, l_orderkey, unnest(CASE WHEN l_quantity > 25 THEN [1, 2] ELSE [2, 3] END) AS phase FROM lineitem) GROUP BY 1, 2")
def phase_counts(t):
    from tidemark.domain.documents import yearly_phase_counts

    p = F.when(F.col("l_quantity") > 25, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))
    studies = t.lineitem.select(F.to_date("l_shipdate").alias("start_date"), F.col("l_orderkey").alias("nct_id"), p.alias("phase_groups"))
    return yearly_phase_counts(studies).withColumnRenamed("year", "y")
