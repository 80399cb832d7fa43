"""Read-side, comparison and document queries on the driver's tables."""

from pyspark.sql import functions as F

from tidemark import compare, readside
from tidemark.domain import documents
from tidemark.plans.base import DENSE, RETURNS, dense, query, r, returns
from tidemark.sources import files


@query(f"""WITH {DENSE}, l AS (SELECT ticker, max(date) AS last FROM bars GROUP BY 1)
SELECT ticker, arg_max(close, date) AS close, round(arg_max(close, date) / nullif(arg_max(close, date) FILTER (WHERE date <= last - 1), 0) - 1, 6) AS d1, round(arg_max(close, date) / nullif(arg_max(close, date) FILTER (WHERE date <= last - 7), 0) - 1, 6) AS w1,
 round(arg_max(close, date) / nullif(arg_max(close, date) FILTER (WHERE date <= last - INTERVAL 1 MONTH), 0) - 1, 6) AS m1, round(arg_max(close, date) / nullif(arg_max(close, date) FILTER (WHERE date <= last - INTERVAL 12 MONTH), 0) - 1, 6) AS y1 FROM bars JOIN l USING (ticker) GROUP BY 1""")
def snapshot(t):
    return readside.snapshot(dense(t)).select("ticker", F.col("last").alias("close"), *[r(c).alias(c) for c in ("d1", "w1", "m1", "y1")])


@query(f"WITH {DENSE} SELECT ticker, date, round(100 * close / first_value(close) OVER (PARTITION BY ticker ORDER BY date), 6) AS rebased FROM bars", dates="date")
def rebase(t):
    return readside.rebase(dense(t)).select("ticker", "date", r("rebased").alias("rebased"))


@query(f"""WITH {DENSE}, x AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
SELECT ticker, max(close) FILTER (WHERE rn = 1) AS close, max(close) FILTER (WHERE rn = 2) AS prev_close, max(close) FILTER (WHERE last - date < 365) AS high_52w, min(close) FILTER (WHERE last - date < 365) AS low_52w FROM x GROUP BY 1""")
def company_header(t):
    b = dense(t)
    return readside.header(b, b.select("ticker", "date", F.col("close").alias("market_cap"))).select("ticker", "close", "prev_close", "high_52w", "low_52w")


@query(f"""WITH {DENSE}, p AS (SELECT ticker, date, close, lag(close) OVER w AS prev, lead(close) OVER w AS nxt FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
e AS (SELECT 'S' || CAST(s_suppkey % 8 AS VARCHAR) AS ticker, s_suppkey, DATE '1996-01-01' + CAST(s_suppkey * 3 AS INTEGER) AS day, CASE WHEN s_acctbal > 5000 THEN 'bmo' ELSE 'amc' END AS time FROM supplier)
SELECT s_suppkey, e.ticker, p.date AS trade_date, round(CASE WHEN time = 'bmo' THEN p.close / prev - 1 ELSE nxt / p.close - 1 END, 6) AS reaction FROM e ASOF LEFT JOIN p ON e.ticker = p.ticker AND e.day >= p.date""", dates="trade_date")
def earnings_reaction(t):
    e = t.supplier.select(F.concat(F.lit("S"), (F.col("s_suppkey") % 8).cast("string")).alias("ticker"), "s_suppkey", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 3).cast("int")).alias("day"), F.when(F.col("s_acctbal") > 5000, "bmo").otherwise("amc").alias("time"))
    return readside.earnings_history(e, dense(t)).select("s_suppkey", "ticker", "trade_date", r("reaction").alias("reaction"))


@query("""WITH q AS (SELECT o_custkey AS corporate_id, year(o_orderdate) AS fy, quarter(o_orderdate) AS fq, sum(o_totalprice) AS revenue, CAST(max(o_totalprice) AS DOUBLE) AS largest FROM orders GROUP BY 1, 2, 3), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY corporate_id ORDER BY fy DESC, fq DESC) <= 4)
SELECT corporate_id, 'revenue' AS item, CASE WHEN count(revenue) = 4 THEN round(sum(revenue), 2) END AS ttm FROM l GROUP BY 1 UNION ALL SELECT corporate_id, 'largest', CASE WHEN count(largest) = 4 THEN round(sum(largest), 2) END FROM l GROUP BY 1""")
def key_figures(t):
    q = t.orders.groupBy(F.col("o_custkey").alias("corporate_id"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("fiscal_quarter")).agg(F.sum("o_totalprice").alias("revenue"), F.max("o_totalprice").alias("largest"))
    return readside.key_figures(q, ["revenue", "largest"]).select("corporate_id", "item", F.round("ttm", 2).alias("ttm"))


@query(f"""WITH {DENSE}, x AS (SELECT ticker, date, open, high, low, close, abs(close / lag(close) OVER w - 1) AS rr, date - lag(date) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, count(*)::BIGINT AS rows, count(*) FILTER (WHERE close IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high))::BIGINT AS bad_ohlc, count(*) FILTER (WHERE rr > 0.5)::BIGINT AS extreme, count(*) FILTER (WHERE rr = 0)::BIGINT AS stale, max(gap)::INT AS longest_gap FROM x GROUP BY 1""")
def price_quality(t):
    return readside.quality_report(dense(t))


@query("""SELECT 'orders' AS name, count(*)::BIGINT AS rows, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest FROM orders UNION ALL SELECT 'events', count(*), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events UNION ALL SELECT 'part', count(*), NULL FROM part""")
def table_status(t):
    return files.table_status(t.spark, {"orders": t.orders.withColumn("d", F.to_date("o_orderdate")), "events": t.events.withColumn("d", F.to_date("ts")), "part": t.part}, {"orders": "d", "events": "d"})


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def page_links(t):
    return files.links(t.pages.select("page_id", "html"), "html", ".").select("page_id", "link")


@query()
def exhibit_lines(t):
    """Names and jurisdictions that the exhibit parser finds in pages."""
    return t.pages.select("page_id", F.inline(documents.parse_subsidiaries("html")))


@query("""WITH p AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' Co. (x) Ltd'), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS s FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split(s, ' '), lambda w: w <> '' AND w NOT IN ('co', 'ltd')), ' ') AS norm FROM p""")
def name_norm(t):
    from tidemark.functions.text import norm_name

    return t.part.select("p_partkey", norm_name(F.concat("p_type", F.lit(" Co. (x) Ltd"))).alias("norm"))


@query(f"""WITH {RETURNS}, w(label, a, b) AS (VALUES ('first', DATE '1995-06-01', DATE '1996-06-01'), ('second', DATE '1997-01-01', DATE '1998-01-01')), j AS (SELECT label, a, ticker, date, exp(sum(r) OVER (PARTITION BY label, ticker ORDER BY date)) AS nav FROM ret JOIN w ON date > a AND date <= b),
l AS (SELECT label, ticker, arg_min(date, (nav, date)) AS trough, min(nav) - 1 AS depth, any_value(a) AS a, max(date) AS last FROM j GROUP BY 1, 2), k AS (SELECT j.label, j.ticker, min(date) AS recovery FROM j JOIN l ON j.label = l.label AND j.ticker = l.ticker AND date > trough AND nav >= 1 GROUP BY 1, 2)
SELECT l.ticker, l.label, trough, round(depth, 6) AS depth, recovery, recovery IS NULL AS censored, date_diff('day', a, coalesce(recovery, last))::INT AS days FROM l LEFT JOIN k ON l.label = k.label AND l.ticker = k.ticker""", dates="trough recovery")
def crisis_episodes(t):
    w = t.spark.createDataFrame([("first", "1995-06-01", "1996-06-01"), ("second", "1997-01-01", "1998-01-01")], "label string, start string, end string").select("label", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return compare.episode(returns(t), w, "ticker", "date", "r").select("ticker", "label", "trough", r("depth").alias("depth"), "recovery", "censored", "days")


@query(f"""WITH {RETURNS}, v AS (SELECT ticker, year(date) AS period, sum(r) AS v FROM ret GROUP BY 1, 2), w AS (SELECT period, abs(sum(v)) / (SELECT sum(abs(s)) FROM (SELECT sum(v) AS s FROM v GROUP BY period)) AS weight FROM v GROUP BY 1)
SELECT ticker, round(sum(v * weight) / sum(weight), 6) AS score FROM v JOIN w USING (period) GROUP BY 1""")
def weighted_score(t):
    v = returns(t).groupBy("ticker", F.year("date").alias("period")).agg(F.sum("r").alias("v"))
    w = compare.severity_weights(v.groupBy("period").agg(F.sum("v").alias("depth"))).select("period", "weight")
    return compare.weighted_score(v, w, ["ticker"], "period", "v").select("ticker", r("score").alias("score"))


@query(f"""WITH {RETURNS}, v AS (SELECT ticker, year(date) AS period, sum(r) AS v FROM ret GROUP BY 1, 2), b AS (SELECT period, v AS b FROM v WHERE ticker = 'BUILDING')
SELECT ticker, count(*) FILTER (WHERE v > b)::BIGINT AS wins, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE v > b) / count(*), 6) AS rate FROM v JOIN b USING (period) WHERE ticker <> 'BUILDING' GROUP BY 1""")
def hit_rates(t):
    v = returns(t).groupBy("ticker", F.year("date").alias("period")).agg(F.sum("r").alias("v"))
    return compare.hit_rates(v, "BUILDING", "ticker", "period", "v").select("ticker", "wins", "n", r("rate").alias("rate"))


@query()
def sharpe_test(t):
    x = returns(t)
    out = compare.sharpe_test(x.where("ticker = 'BUILDING'"), x.where("ticker = 'MACHINERY'"), "date", "r", "r")
    return out.select("n", *[r(c).alias(c) for c in ("sharpe_a", "sharpe_b", "difference", "z", "p")])


@query("""WITH q AS (SELECT o_custkey AS c, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), u AS (SELECT c, y, k, sum(v) OVER (PARTITION BY c, y ORDER BY k) AS ytd, lag(k) OVER (PARTITION BY c, y ORDER BY k) AS pk FROM q),
z AS (SELECT *, lag(ytd) OVER (PARTITION BY c, y ORDER BY k) AS prev FROM u) SELECT c, y, k, round(CASE WHEN k = 1 THEN ytd WHEN pk = k - 1 THEN ytd - prev END, 2) AS quarter FROM z""")
def ytd_to_quarter(t):
    from pyspark.sql import Window

    q = t.orders.groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("c", "y").orderBy("k")
    u = q.withColumn("ytd", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pk", F.lag("k").over(w)).withColumn("prev", F.lag("ytd").over(w))
    return u.select("c", "y", "k", F.round(F.when(F.col("k") == 1, F.col("ytd")).when(F.col("pk") == F.col("k") - 1, F.col("ytd") - F.col("prev")), 2).alias("quarter"))
