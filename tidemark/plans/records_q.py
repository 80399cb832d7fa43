"""Backtest records, comparison tables, read functions, calendars and grouping sets on the driver's tables."""

from pyspark.sql import functions as F

from tidemark import backtest, compare, metrics, portfolio, readside
from tidemark.plans.base import DENSE, RETURNS, dense, query, r, returns

_STEPS = f"""{DENSE}, x AS (SELECT ticker, date, close AS nav, close / lag(close) OVER w - 1 AS ret,
 close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _record(t):
    return backtest.backtest_record(dense(t), "ticker", "date", "close")


@query(f"""WITH {_STEPS}, v AS (SELECT ticker, quantile_cont(ret, 0.05) AS var, avg(ret) AS m, var_pop(ret) AS vp FROM x GROUP BY 1),
g AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(ret)::BIGINT AS n_days, date_diff('day', min(date), max(date)) / 365.25 AS y,
 arg_max(nav, date) / arg_min(nav, date) - 1 AS total, min(dd) AS mdd, avg(dd) FILTER (WHERE dd < 0) AS add, stddev_samp(ret) AS sd, avg(ret) AS m,
 sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) * sqrt(252) AS down, sqrt(avg(ret * ret) FILTER (WHERE ret < power(1.04, 1 / 252.0) - 1)) * sqrt(252) AS below,
 avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS win, sum(ret) FILTER (WHERE ret > 0) / -sum(ret) FILTER (WHERE ret < 0) AS pf,
 quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05)) AS tail FROM x GROUP BY 1),
s AS (SELECT ticker, avg(power(ret - m, 3)) / power(any_value(vp), 1.5) AS skew, avg(power(ret - m, 4)) / power(any_value(vp), 2) - 3 AS kurt,
 avg(ret) FILTER (WHERE ret <= var + 1e-12) AS cvar, any_value(var) AS var FROM x JOIN v USING (ticker) GROUP BY 1)
SELECT ticker, start_date, end_date, n_days, round(total, 6) AS total_return, round(power(1 + total, 1 / y) - 1, 6) AS cagr, round(sd * sqrt(252), 6) AS annual_volatility,
 round(down, 6) AS downside_deviation, round(mdd, 6) AS max_drawdown, round(add, 6) AS avg_drawdown, round(total / abs(mdd), 6) AS recovery_factor,
 round((m - power(1.04, 1 / 252.0) + 1) / sd * sqrt(252), 6) AS sharpe_ratio, round((m - power(1.04, 1 / 252.0) + 1) * 252 / below, 6) AS sortino_ratio,
 round(var, 6) AS var_historical, round(cvar, 6) AS cvar_historical, round(m - 1.6448536269514729 * sd, 6) AS var_parametric,
 round(m - 0.10313564037537139 / 0.05 * sd, 6) AS cvar_parametric, round(skew, 6) AS skewness, round(kurt, 6) AS excess_kurtosis, round(tail, 6) AS tail_ratio,
 round(win, 6) AS win_rate, round(pf, 6) AS profit_factor FROM g JOIN s USING (ticker)""", dates="start_date end_date")
def backtest_record(t):
    numbers = ("total_return", "cagr", "annual_volatility", "downside_deviation", "max_drawdown", "avg_drawdown", "recovery_factor", "sharpe_ratio", "sortino_ratio", "var_historical",
               "cvar_historical", "var_parametric", "cvar_parametric", "skewness", "excess_kurtosis", "tail_ratio", "win_rate", "profit_factor")
    return _record(t).select("ticker", "start_date", "end_date", "n_days", *[r(c).alias(c) for c in numbers])


def _extremes(unit: str, end: str) -> str:
    return f"""{unit}s AS (SELECT ticker, date_trunc('{unit}', date) AS p, arg_min(nav, date) AS a, arg_max(nav, date) AS b, count(ret) AS n FROM x GROUP BY 1, 2),
{unit}r AS (SELECT ticker, CAST(p + {end} AS DATE) - 1 AS e, n, b / coalesce(lag(b) OVER (PARTITION BY ticker ORDER BY p), a) - 1 AS v FROM {unit}s),
{unit}b AS (SELECT ticker, max(v) AS best, min(v) AS worst, arg_min(e, (-v, e)) AS best_at, arg_min(e, (v, e)) AS worst_at FROM {unit}r WHERE n > 0 GROUP BY 1)"""


@query(f"""WITH {_STEPS}, {_extremes('month', 'INTERVAL 1 MONTH')}, {_extremes('year', 'INTERVAL 1 YEAR')},
d AS (SELECT ticker, max(ret) AS best, min(ret) AS worst, arg_min(date, (-ret, date)) AS best_at, arg_min(date, (ret, date)) AS worst_at FROM x WHERE ret IS NOT NULL GROUP BY 1)
SELECT d.ticker, round(d.best, 6) AS best_day, d.best_at AS best_day_date, round(d.worst, 6) AS worst_day, d.worst_at AS worst_day_date,
 round(m.best, 6) AS best_month, m.best_at AS best_month_date, round(m.worst, 6) AS worst_month, m.worst_at AS worst_month_date,
 round(y.best, 6) AS best_year, y.best_at AS best_year_date, round(y.worst, 6) AS worst_year, y.worst_at AS worst_year_date
 FROM d JOIN monthb m ON d.ticker = m.ticker JOIN yearb y ON d.ticker = y.ticker""",
       dates="best_day_date worst_day_date best_month_date worst_month_date best_year_date worst_year_date")
def backtest_extremes(t):
    sides = [f"{side}_{unit}" for unit in ("day", "month", "year") for side in ("best", "worst")]
    return _record(t).select("ticker", *[r(c).alias(c) for c in sides], *[f"{c}_date" for c in sides])


@query(f"""WITH {_STEPS}, k AS (SELECT ticker, date, dd < 0 AS u, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, dd < 0 ORDER BY date) AS g FROM x),
e AS (SELECT ticker, u, min(date) AS a, max(date) AS b FROM k GROUP BY ticker, u, g),
s AS (SELECT ticker, sign(ret) AS s, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, sign(ret) ORDER BY date) AS g FROM x WHERE ret IS NOT NULL),
n AS (SELECT ticker, s, count(*) AS n FROM s GROUP BY ticker, s, g), o AS (SELECT ticker, coalesce(max(n) FILTER (WHERE s > 0), 0)::BIGINT AS w, coalesce(max(n) FILTER (WHERE s < 0), 0)::BIGINT AS l FROM n GROUP BY 1)
SELECT e.ticker, coalesce(max(b - a) FILTER (WHERE u), 0)::INT AS max_dd_duration_days, round(coalesce(avg(b - a) FILTER (WHERE u), 0.0), 6) AS avg_dd_duration_days,
 arg_max(CASE WHEN u THEN b - a ELSE 0 END, b)::INT AS current_dd_duration_days, any_value(w) AS max_consecutive_wins, any_value(l) AS max_consecutive_losses FROM e JOIN o ON e.ticker = o.ticker GROUP BY 1""")
def backtest_durations(t):
    return _record(t).select("ticker", "max_dd_duration_days", r("avg_dd_duration_days").alias("avg_dd_duration_days"), "current_dd_duration_days", "max_consecutive_wins", "max_consecutive_losses")


@query("""SELECT round(coalesce(avg(value) FILTER (WHERE event_type = 'absent') / 100, avg(value) FILTER (WHERE event_type = 'click') / 100, 0.04), 6) AS rf_rate FROM events WHERE CAST(ts AS DATE) >= DATE '1995-01-01'""")
def rf_rate(t):
    macro = t.events.select(F.to_date("ts").alias("date"), *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("absent", "click")])
    return backtest.rf_rate(macro, ["absent", "click"], start="1995-01-01").select(r("rf_rate").alias("rf_rate"))


_BENCH = "b AS (SELECT date, avg(r) AS b FROM ret GROUP BY 1)"
_CRISES = "c(label, peak, trough, even) AS (VALUES ('first', DATE '1995-06-01', DATE '1996-06-01', DATE '1996-12-01'), ('second', DATE '1997-01-01', DATE '1998-01-01', DATE '2000-06-01'))"


def _bench(t):
    x = returns(t)
    return x, x.groupBy("date").agg(F.avg("r").alias("b"))


def _crises(t):
    rows = [("first", "1995-06-01", "1996-06-01", "1996-12-01"), ("second", "1997-01-01", "1998-01-01", "2000-06-01")]
    c = t.spark.createDataFrame(rows, "label string, peak string, trough string, even string")
    return c.withColumns({k: F.col(k).cast("date") for k in ("peak", "trough", "even")})


def _window_sql(windows: str) -> str:
    return f"""{windows}, j AS (SELECT label, phase, ticker, date, r, exp(sum(r) OVER (PARTITION BY label, phase, ticker ORDER BY date)) AS nav FROM ret JOIN w ON date > a AND date <= z),
d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY label, phase, ticker ORDER BY date), 1.0) - 1 AS dd FROM j), q AS (SELECT label, phase, exp(sum(b)) - 1 AS bench FROM b JOIN w ON date > a AND date <= z GROUP BY 1, 2),
g AS (SELECT ticker, label, phase, count(*)::BIGINT AS n, exp(sum(r)) - 1 AS cum, min(dd) AS max_dd, sqrt(sum(dd * dd) / (count(*) + 1)) AS ulcer, stddev_samp(r) * sqrt(12) AS vol,
 avg(CASE WHEN dd < -1e-12 THEN 1.0 ELSE 0.0 END) AS share, arg_max(nav, date) >= 1 - 1e-12 AS recovered FROM d GROUP BY 1, 2, 3)"""


@query(f"""WITH {RETURNS}, {_BENCH}, {_CRISES}, {_window_sql("w AS (SELECT label, 'full' AS phase, peak AS a, even AS z FROM c)")}
SELECT ticker, label, n, round(cum, 6) AS cum_return, round((1 + cum) / (1 + bench) - 1, 6) AS excess_return, round(max_dd, 6) AS max_dd, round(ulcer, 6) AS ulcer,
 round(vol, 6) AS ann_vol, round(share, 6) AS underwater_share, recovered FROM g JOIN q USING (label, phase)""")
def crisis_table(t):
    x, b = _bench(t)
    windows = _crises(t).select("label", F.col("peak").alias("start"), F.col("even").alias("end"))
    out = compare.window_table(x, b, windows, "ticker", "date", "r", "b", f=12)
    return out.select("ticker", "label", "n", "recovered", *[r(c).alias(c) for c in ("cum_return", "excess_return", "max_dd", "ulcer", "ann_vol", "underwater_share")])


@query(f"""WITH {RETURNS}, {_BENCH}, {_CRISES}, {_window_sql("w AS (SELECT label, 'ptt' AS phase, peak AS a, trough AS z FROM c UNION ALL SELECT label, 'ttp', trough, even FROM c)")}
SELECT ticker, label, """ + ", ".join(f"round(max({e}) FILTER (WHERE phase = '{p}'), 6) AS {p}_{c}" for p in ("ptt", "ttp") for c, e in (
    ("cum_return", "cum"), ("excess_return", "(1 + cum) / (1 + bench) - 1"), ("capture", "cum / nullif(bench, 0)"), ("max_dd", "max_dd"))) + " FROM g JOIN q USING (label, phase) GROUP BY 1, 2")
def phase_table(t):
    x, b = _bench(t)
    out = compare.phase_table(x, b, _crises(t), "ticker", "date", "r", "b")
    return out.select("ticker", "label", *[r(f"{p}_{c}").alias(f"{p}_{c}") for p in ("ptt", "ttp") for c in ("cum_return", "excess_return", "capture", "max_dd")])


@query(f"""WITH {RETURNS}, {_CRISES}, j AS (SELECT label, ticker, date, exp(sum(r) OVER (PARTITION BY label, ticker ORDER BY date)) AS nav FROM ret JOIN c ON date > peak AND date <= even),
d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY label, ticker ORDER BY date), 1.0) - 1 AS dd FROM j), l AS (SELECT label, ticker, min(nav) AS low, arg_min(date, (nav, date)) AS low_at FROM j GROUP BY 1, 2),
k AS (SELECT label, ticker, min(date) AS back FROM j JOIN l USING (label, ticker) WHERE date > low_at AND nav >= 1 GROUP BY 1, 2)
SELECT ticker, label, round(sqrt(sum(CASE WHEN low < 1 AND (back IS NULL OR date <= back) THEN dd * dd ELSE 0.0 END) / (count(*) + 1)), 6) AS ulcer_common
 FROM d JOIN l USING (label, ticker) LEFT JOIN k USING (label, ticker) GROUP BY 1, 2""")
def common_ulcer(t):
    windows = _crises(t).select("label", F.col("peak").alias("start"), F.col("even").alias("end"))
    return compare.common_ulcer(returns(t), windows, "ticker", "date", "r").select("ticker", "label", r("ulcer_common").alias("ulcer_common"))


@query(f"""WITH {RETURNS}, {DENSE}, p AS (SELECT 'S' || CAST(row_number() OVER (ORDER BY ticker) - 1 AS VARCHAR) AS ticker, mv FROM (SELECT ticker, list(ROW(date, r < 0)) AS mv FROM ret GROUP BY 1)),
e AS (SELECT ticker, unnest(mv) AS m FROM p), s AS (SELECT ticker, m[1] AS decided, m[2] AS flag FROM e)
SELECT b.ticker, round(avg(CASE WHEN flag THEN 1.0 WHEN NOT flag THEN 0.0 END), 6) AS crisis_share FROM bars b ASOF LEFT JOIN s ON b.ticker = s.ticker AND b.date >= s.decided GROUP BY 1""")
def crisis_share(t):
    from pyspark.sql import Window

    x = returns(t)
    names = x.select("ticker").distinct().withColumn("name", F.concat(F.lit("S"), (F.row_number().over(Window.orderBy("ticker")) - 1).cast("string")))  # segments, a handful
    decisions = x.join(F.broadcast(names), "ticker").select(F.col("name").alias("ticker"), F.col("date").alias("decided"), (F.col("r") < 0).alias("flag"))
    return compare.crisis_share(dense(t).select("ticker", "date"), decisions, "ticker", "date", "decided", "flag").select("ticker", r("crisis_share").alias("crisis_share"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH {RETURNS}, v AS (SELECT year(date)::INT AS period, ticker, sum(r) AS total, max(r) AS best FROM ret GROUP BY 1, 2), u AS (SELECT 'total' AS metric, period, ticker, total AS v FROM v UNION ALL SELECT 'best', period, ticker, best FROM v)
SELECT metric, period, """ + ", ".join(f"round(max(v) FILTER (WHERE ticker = '{s}'), 6) AS {s}" for s in _SEGMENTS) + " FROM u GROUP BY 1, 2")
def value_tables(t):
    v = returns(t).groupBy(F.year("date").alias("period"), "ticker").agg(F.sum("r").alias("total"), F.max("r").alias("best")).unpivot(["period", "ticker"], ["total", "best"], "metric", "v")
    return compare.value_table(v, "metric", "period", "ticker", "v", _SEGMENTS).select("metric", "period", *[r(s).alias(s) for s in _SEGMENTS])


@query(f"WITH {RETURNS} SELECT year(date)::INT AS year, " + ", ".join(f"round(exp(sum(r) FILTER (WHERE month(date) = {i})) - 1, 6) AS m{i}" for i in range(1, 13)) + " FROM ret GROUP BY 1")
def month_returns(t):
    return metrics.month_table(returns(t), "date", "r").select("year", *[r(f"m{i}").alias(f"m{i}") for i in range(1, 13)])


@query("SELECT min(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate)", dates="date")
def rebalance_calendar(t):
    return portfolio.rebalance_dates(t.orders.select(F.to_date("o_orderdate").alias("date")), "Quarterly")


# read functions -----------------------------------------------------------------------------------------------------
@query("""SELECT o_custkey AS corporate_id, CAST(o_orderdate AS DATE) AS filed_date, o_orderpriority AS form_type, o_custkey || '/' || replace(CAST(o_orderdate AS DATE)::VARCHAR, '-', '') || '/' || o_orderkey || '.htm' AS path
 FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) <= 8""", dates="filed_date")
def company_filings(t):
    rows = t.orders.select(F.col("o_custkey").alias("corporate_id"), F.to_date("o_orderdate").alias("filed_date"), F.col("o_orderpriority").alias("form_type"), F.col("o_orderkey").alias("accession_no"))
    rows = rows.withColumn("folder", F.date_format("filed_date", "yyyy-MM-dd")).withColumn("doc", F.concat(F.col("accession_no").cast("string"), F.lit(".htm")))
    out = readside.filings(rows, forms=("1-URGENT", "3-MEDIUM"))
    return out.select("corporate_id", "filed_date", "form_type", readside.filing_path("corporate_id", "folder", "doc").alias("path"))


@query("""WITH q AS (SELECT o_custkey AS c, year(o_orderdate) AS y, quarter(o_orderdate) AS k, max(CAST(o_orderdate AS DATE)) AS e, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
SELECT c AS corporate_id, 'Q' || k || ' ' || y AS label, round(v, 2) AS revenue FROM q QUALIFY row_number() OVER (PARTITION BY c ORDER BY e DESC) <= 10""")
def company_quarters(t):
    d = F.to_date("o_orderdate")
    rows = t.orders.groupBy(F.col("o_custkey").alias("corporate_id"), F.year(d).alias("fiscal_year"), F.quarter(d).alias("fiscal_quarter")).agg(F.max(d).alias("period_end"), F.sum("o_totalprice").alias("revenue"))
    return readside.financials(rows, quarterly=True).select("corporate_id", "label", F.round("revenue", 2).alias("revenue"))


@query("""WITH y AS (SELECT o_custkey AS corporate_id, year(o_orderdate)::INT AS fiscal_year, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS annual_report_date FROM orders GROUP BY 1, 2)
SELECT * FROM y WHERE annual_report_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corporate_id ORDER BY fiscal_year DESC) <= 6""", dates="annual_report_date")
def annual_reports(t):
    d = F.to_date("o_orderdate")
    rows = t.orders.groupBy(F.col("o_custkey").alias("corporate_id"), F.year(d).alias("fiscal_year")).agg(F.max(F.when(F.col("o_orderstatus") == "F", d)).alias("annual_report_date"))
    return readside.annual_reports(rows).select("corporate_id", "fiscal_year", "annual_report_date")


@query(f"WITH {DENSE}, x AS (SELECT ticker, date, high - low AS dividends FROM bars) SELECT ticker, date, round(dividends, 6) AS dividends FROM x WHERE dividends > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 12", dates="date")
def dividends(t):
    x = dense(t).withColumn("dividends", F.col("high") - F.col("low"))
    return readside.dividends_splits(x, x)[0].select("ticker", "date", r("dividends").alias("dividends"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS has_intraday FROM customer""")
def intraday_there(t):
    return readside.has_intraday(t.customer.select("c_custkey"), t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("""SELECT l_suppkey AS corporate_id, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS filing_date, round(l_quantity * l_discount, 6) AS value, CASE WHEN l_returnflag = 'R' THEN TRUE ELSE FALSE END AS date_suspect
 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey * 10 + l_linenumber DESC) <= 50""", dates="filing_date")
def insider_trades(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("corporate_id"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("filing_date"), F.to_date("l_shipdate").alias("trans_date"),
                             F.col("l_quantity").alias("shares"), F.col("l_discount").alias("price"), F.when(F.col("l_returnflag") == "R", True).alias("date_suspect"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("accession_no"))
    return readside.insider_transactions(rows).select("corporate_id", "l_orderkey", "l_linenumber", "filing_date", r("value").alias("value"), "date_suspect")


@query("""SELECT o_custkey AS nct_id, o_orderkey AS version, (row_number() OVER w)::INT AS age, date_diff('day', lead(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE))::INT AS days_since
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC)""")
def trial_versions(t):
    raw = t.orders.select(F.col("o_custkey").alias("nct_id"), F.col("o_orderkey").alias("version"), F.to_date("o_orderdate").alias("downloaded_at"))
    return readside.trial_versions(raw).select("nct_id", "version", "age", "days_since")


# windows over time, grouping sets ---------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS bar, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2""")
def sliding_windows(t):
    g = t.events.groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bar"), "n", "total")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, g""")
def session_windows(t):
    g = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS all_status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("all_status"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), quarter(o_orderdate))")
def rollup_periods(t):
    return t.orders.rollup(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"))
