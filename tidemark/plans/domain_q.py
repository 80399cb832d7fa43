"""Domain queries on the driver's tables: market caps, FX conversion, holdings, models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.domain import fx, holders, marketcap
from tidemark.plans.base import DENSE, dense, query, r

_CAPS = f"""{DENSE}, act AS (SELECT ticker, arg_max(date, (volume, date)) AS date FROM bars GROUP BY 1), ev AS (SELECT DISTINCT ticker, make_date(year(date), 1, 1) AS d, 1e6 * (1 + year(date) % 5) AS shares FROM bars),
px AS (SELECT b.ticker, b.date, close, CASE WHEN b.date < act.date THEN 2.0 ELSE 1.0 END AS after FROM bars b JOIN act USING (ticker)),
caps AS (SELECT px.ticker, px.date, shares / after AS shares_outstanding, close * shares AS market_cap FROM px ASOF JOIN ev ON px.ticker = ev.ticker AND px.date >= ev.d)"""


def _caps(t):
    b = dense(t)
    act = b.groupBy("ticker").agg(F.max_by("date", F.struct("volume", "date")).alias("date")).withColumn("yahoo_factor", F.lit(2.0)).withColumn("split_factor", F.lit(2.0))
    comp = b.select("ticker").distinct().select(F.col("ticker").alias("corporate_id"), F.col("ticker").alias("primary_ticker"))
    ev = b.select(F.col("ticker").alias("corporate_id"), F.make_date(F.year("date"), F.lit(1), F.lit(1)).alias("d"), (1e6 * (1 + F.year("date") % 5)).alias("shares_today"), F.lit("sec_cover_page").alias("src")).distinct()
    px = b.withColumn("currency", F.lit("USD")).withColumn("fx_to_usd", F.lit(1.0))
    return marketcap.market_cap(px, comp, act, ev), act


@query(f"WITH {_CAPS} SELECT ticker, date, round(shares_outstanding, 2) AS shares_outstanding, round(market_cap, 2) AS market_cap FROM caps", dates="date")
def market_cap_daily(t):
    caps, _ = _caps(t)
    return caps.select(F.col("primary_ticker").alias("ticker"), "date", F.round("shares_outstanding", 2).alias("shares_outstanding"), F.round("market_cap", 2).alias("market_cap"))


@query(f"""WITH {_CAPS}, m AS (SELECT *, lag(market_cap) OVER w AS p, lag(shares_outstanding) OVER w AS ps FROM caps WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT m.ticker, m.date, round(market_cap / p - 1, 6) AS change, CASE WHEN abs(shares_outstanding / ps - 1) < 0.05 THEN 'price' ELSE 'shares' END AS driver FROM m WHERE p > 0 AND abs(market_cap / p - 1) > 0.3 AND NOT EXISTS (SELECT 1 FROM act WHERE act.ticker = m.ticker AND act.date = m.date)""", dates="date")
def market_cap_jumps(t):
    caps, act = _caps(t)
    return marketcap.jump_check(caps, act).select(F.col("primary_ticker").alias("ticker"), "date", r("change").alias("change"), "driver")


@query("""WITH p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, value AS close, CASE WHEN user_id % 3 = 0 THEN 'USD' WHEN user_id % 3 = 1 THEN 'GBp' ELSE 'EUR' END AS currency FROM events), q AS (SELECT CASE WHEN event_type = 'click' THEN 'GBP' ELSE 'EUR' END AS currency, CAST(ts AS DATE) AS rate_date, avg(value) AS rate FROM events WHERE event_type IN ('click', 'view') AND day(ts) <= 20 GROUP BY 1, 2)
SELECT event_id, round(close * CASE WHEN p.currency = 'USD' THEN 1.0 WHEN date - rate_date <= 5 THEN rate / CASE WHEN p.currency = 'GBp' THEN 100.0 ELSE 1.0 END END, 6) AS close_usd FROM p ASOF LEFT JOIN q ON upper(p.currency) = q.currency AND p.date >= q.rate_date""")
def usd_conversion(t):
    cur = F.when(F.col("user_id") % 3 == 0, "USD").when(F.col("user_id") % 3 == 1, "GBp").otherwise("EUR")
    p = t.events.select("event_id", F.to_date("ts").alias("date"), F.col("value").alias("close"), cur.alias("currency"))
    q = t.events.where(F.col("event_type").isin("click", "view") & (F.dayofmonth("ts") <= 20)).groupBy(F.when(F.col("event_type") == "click", "GBP").otherwise("EUR").alias("currency"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("usd_per_unit"))
    return fx.apply_usd(p, q).select("event_id", r("close_usd").alias("close_usd"))


@query("""WITH f AS (SELECT o_custkey AS filer, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'original' WHEN o_orderpriority = '3-MEDIUM' THEN 'restatement' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'new' END AS kind FROM orders),
base AS (SELECT * FROM f WHERE kind IN ('original', 'restatement') QUALIFY row_number() OVER (PARTITION BY filer, period ORDER BY filed DESC, CAST(accession AS VARCHAR) DESC) = 1),
used AS (SELECT accession, filed, filer, period FROM base UNION ALL SELECT f.accession, f.filed, f.filer, f.period FROM f JOIN base b USING (filer, period) WHERE f.kind = 'new' AND f.filed >= b.filed)
SELECT filer, period, l_partkey AS cusip, round(sum(l_quantity), 2) AS shares, round(sum(l_extendedprice * CASE WHEN filed < DATE '2023-01-03' THEN 1000 ELSE 1 END), 0) AS value_usd FROM used JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem) ON l_orderkey = accession WHERE l_quantity > 0 GROUP BY 1, 2, 3""", dates="period")
def holdings(t):
    p = F.col("o_orderpriority")
    o = t.orders.where(p != "5-LOW")
    period = F.to_date(F.trunc("o_orderdate", "quarter"))
    sub = o.select(F.col("o_orderkey").cast("string").alias("accession"), F.to_date("o_orderdate").alias("filing_date"), F.when(p.isin("1-URGENT", "2-HIGH"), "13F-HR").otherwise("13F-HR/A").alias("submission_type"), F.col("o_custkey").alias("filer_cik"), period.alias("period"))
    cov = o.select(F.col("o_orderkey").cast("string").alias("accession"), F.when(p == "3-MEDIUM", "RESTATEMENT").when(p == "4-NOT SPECIFIED", "NEW HOLDINGS").alias("amendment_type"), F.lit("m").alias("manager"))
    info = t.lineitem.select(F.col("l_orderkey").cast("string").alias("accession"), F.col("l_partkey").alias("cusip"), F.lit("i").alias("issuer"), F.lit("t").alias("title"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("shares"))
    return holders.holdings(sub, cov, info, sub.select("period").distinct()).select(F.col("filer_cik").alias("filer"), "period", "cusip", F.round("shares", 2).alias("shares"), F.round("value_usd", 0).alias("value_usd"))


@query()
def forest_scores(t):
    """Walk-forward scores of order values from customers' past quarters, on the first quarter of each year with three years before it.

    One small configuration stands for the grid: 144 forests of 300 trees a date are a batch job, not a query.
    """
    from tidemark import models

    q = t.orders.groupBy(F.col("o_custkey").cast("string").alias("ticker"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("asof")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("ticker").orderBy("asof")
    x = q.withColumn("a", F.try_divide("v", F.lag("v").over(w)) - 1).withColumn("b", F.col("n").cast("double")).withColumn("label", F.try_divide(F.lead("v").over(w), F.col("v")) - 1)
    ends = q.agg(F.year(F.min("asof")).alias("a"), F.year(F.max("asof")).alias("b")).first()
    dates = [f"{y}-01-01" for y in range(ends.a + 3, ends.b + 1)]
    out = models.walk_forward(x, dates, ["a", "b"], "rf", years=3, resolved_days=90, seeds=(1,), grid={"maxDepth": [5], "minInstancesPerNode": [20], "numTrees": [20]})
    return models.score_weights(out).select(F.date_format("asof", "yyyy-MM-dd").alias("asof"), "ticker", r("weight", 4).alias("weight"))


@query("""WITH q AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, count(*)::DOUBLE AS b FROM orders GROUP BY 1, 2), c AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM (SELECT DISTINCT as_of FROM q)),
s AS (SELECT ticker, as_of, i, min(i) OVER w AS first, count(*) OVER w AS n, sum(b) OVER w AS total FROM q JOIN c USING (as_of) WINDOW w AS (PARTITION BY ticker ORDER BY as_of ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT ticker, as_of, total FROM s WHERE n = 4 AND i - first = 3""", dates="as_of")
def feature_sequences(t):
    from tidemark import models

    q = t.orders.groupBy(F.col("o_custkey").cast("string").alias("ticker"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("asof")).agg(F.count("*").cast("double").alias("b"))
    s = models.sequences(q, ["b"], 4)
    return s.select("ticker", F.col("asof").alias("as_of"), F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0]).alias("total"))
