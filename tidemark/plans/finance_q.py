"""Indicators, risk metrics, features, portfolios and regimes on the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import indicators, metrics
from tidemark.domain import prices
from tidemark.plans.base import BARS, DENSE, RETURNS, bars, dense, query, r, returns

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date), w14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w34 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 33 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), wc AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {BARS}, a AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lag(close) OVER w AS prev, CASE WHEN count(*) OVER w14 = 14 THEN min(low) OVER w14 END AS lo, CASE WHEN count(*) OVER w14 = 14 THEN max(high) OVER w14 END AS hi,
 CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma20, CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS sd20, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER w AS tp1,
 max(close) OVER w252 AS high252, min(close) OVER w252 AS low252, lag(close, 14) OVER w AS c14, power(100 * (close - max(close) OVER w14) / max(close) OVER w14, 2) AS dd2,
 CASE WHEN count(*) OVER w34 = 34 THEN avg((high + low) / 2) OVER w5 - avg((high + low) / 2) OVER w34 END AS ao FROM bars {_W}),
b AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k, CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END AS neg FROM a)
SELECT ticker, date, round(ret, 6) AS return_1d, round(sma20 + 2 * sd20, 4) AS bb_upper, round(high252, 8) AS high_252d, round(low252, 8) AS low_252d, round(close / high252 - 1, 6) AS drawdown, round(100 * (close - c14) / c14, 4) AS roc_14,
 round(k, 4) AS stoch_k, CASE WHEN count(k) OVER w3 = 3 THEN round(avg(k) OVER w3, 4) END AS stoch_d, round(-100 * (hi - close) / nullif(hi - lo, 0), 4) + 0.0 AS williams_r, round(ao, 4) AS awesome,
 round(greatest(high - low, abs(high - prev), abs(low - prev)), 8) AS true_range, CASE WHEN count(dd2) OVER w14 = 14 THEN round(sqrt(avg(dd2) OVER w14), 4) END AS ulcer_14,
 CASE WHEN count(ret) OVER w20 = 20 THEN round(stddev_samp(ret) OVER w20 * sqrt(252), 4) END AS volatility_20d, round(sum(coalesce(sign(close - prev) * volume, 0)) OVER wc, 2) AS obv, round(sum(coalesce(ret * volume, 0)) OVER wc, 2) AS pvt,
 CASE WHEN count(*) OVER w14 = 14 THEN CASE WHEN sum(neg) OVER w14 > 0 THEN round(100 - 100 / (1 + sum(pos) OVER w14 / sum(neg) OVER w14), 4) WHEN sum(pos) OVER w14 > 0 THEN 100.0 END END AS mfi_14 FROM b {_W}""", dates="date")
def technical_indicators(t):
    out = indicators.window_indicators(bars(t))
    four, eight = ("bb_upper", "roc_14", "stoch_k", "stoch_d", "williams_r", "awesome", "ulcer_14", "volatility_20d", "mfi_14"), ("high_252d", "low_252d", "true_range")
    return out.select("ticker", "date", r("return_1d").alias("return_1d"), r("drawdown").alias("drawdown"), *[r(c, 4).alias(c) for c in four], *[r(c, 8).alias(c) for c in eight], r("obv", 2).alias("obv"), r("pvt", 2).alias("pvt"))


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars),
e AS (SELECT ticker, date, i, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, close FROM n WHERE i = 1 UNION ALL
 SELECT n.ticker, n.date, n.i, e12 + (n.close - e12) * 2 / 13.0, e26 + (n.close - e26) * 2 / 27.0,
  CASE WHEN g IS NULL THEN greatest(n.close - e.close, 0) ELSE g + (greatest(n.close - e.close, 0) - g) / 14.0 END, CASE WHEN l IS NULL THEN greatest(e.close - n.close, 0) ELSE l + (greatest(e.close - n.close, 0) - l) / 14.0 END, n.close FROM e JOIN n ON e.ticker = n.ticker AND n.i = e.i + 1)
SELECT ticker, date, round(e12 - e26, 3) AS macd, CASE WHEN i > 14 THEN round(100 - 100 / (1 + g / l), 3) END AS rsi_14 FROM e""", dates="date")
def ema_macd_rsi(t):
    return indicators.recursive_indicators(bars(t)).select("ticker", "date", r("macd", 3).alias("macd"), r(F.nanvl("rsi_14", F.lit(None).cast("double")), 3).alias("rsi_14"))


@query()
def psar_atr(t):
    return indicators.recursive_indicators(bars(t)).select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), r("psar", 4).alias("psar"), r("atr_14", 4).alias("atr_14"))


_NAV = f"""{RETURNS}, nav AS (SELECT ticker, date, r, exp(sum(r) OVER (PARTITION BY ticker ORDER BY date)) AS nav FROM ret),
dd AS (SELECT ticker, date, r, nav, nav / greatest(max(nav) OVER (PARTITION BY ticker ORDER BY date), 1.0) - 1 AS dd FROM nav)"""


@query(f"""WITH {_NAV}, i AS (SELECT ticker, date, dd, sum(CASE WHEN dd < -1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM dd), n AS (SELECT ticker, g, count(*) FILTER (WHERE dd < -1e-12) AS n FROM i GROUP BY 1, 2),
m AS (SELECT ticker, max(n) AS n FROM n GROUP BY 1) SELECT dd.ticker, round(min(dd), 6) AS max_drawdown, round(sqrt(avg(dd * dd)), 6) AS ulcer_index, any_value(m.n)::BIGINT AS max_duration FROM dd JOIN m USING (ticker) GROUP BY 1""")
def drawdown_metrics(t):
    return metrics.drawdown_summary(returns(t), "ticker", "date", "r").select("ticker", r("max_drawdown").alias("max_drawdown"), r("ulcer_index").alias("ulcer_index"), F.col("max_duration").cast("long").alias("max_duration"))


@query(f"""WITH {RETURNS} SELECT ticker, count(*)::BIGINT AS n, round(exp(sum(r)) - 1, 6) AS cumulative, round(exp(avg(r) * 12) - 1, 6) AS annual_return, round(stddev_samp(r) * sqrt(12), 6) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe,
 round(avg(r) / sqrt(avg(power(least(r, 0), 2))) * sqrt(12), 6) AS sortino, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0), 6) AS profit_factor,
 round(quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)), 6) AS tail_ratio, arg_max(date, (r, date)) AS best_day, arg_min(date, (r, date)) AS worst_day, round(avg(r) - 1.6448536269514729 * stddev_samp(r), 6) AS var_parametric FROM ret GROUP BY 1""", dates="best_day worst_day")
def risk_metrics(t):
    p = metrics.performance(returns(t), "ticker", "date", "r", f=12)
    six = ("cumulative", "annual_return", "volatility", "sharpe", "sortino", "win_rate", "profit_factor", "tail_ratio", "var_parametric")
    return p.select("ticker", "n", "best_day", "worst_day", *[r(c).alias(c) for c in six])


@query(f"""WITH {RETURNS}, v AS (SELECT ticker, quantile_cont(exp(r) - 1, 0.05) AS v FROM ret GROUP BY 1) SELECT ticker, round(any_value(v), 6) AS var, round(avg(exp(r) - 1) FILTER (WHERE exp(r) - 1 <= v + 1e-12), 6) AS cvar FROM ret JOIN v USING (ticker) GROUP BY 1""")
def var_cvar(t):
    return metrics.conditional_value_at_risk(returns(t), "ticker", "r").select("ticker", r("var").alias("var"), r("cvar").alias("cvar"))


@query(f"""WITH {RETURNS}, b AS (SELECT date, avg(r) AS b FROM ret GROUP BY 1), j AS (SELECT * FROM ret JOIN b USING (date))
SELECT ticker, round(covar_samp(r, b) / var_samp(b), 6) AS beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 6) AS alpha, round(corr(r, b), 6) AS correlation, round(stddev_samp(r - b) * sqrt(252), 6) AS tracking_error FROM j GROUP BY 1""")
def beta_alpha(t):
    x = returns(t)
    return metrics.against_benchmark(x, x.groupBy("date").agg(F.avg("r").alias("b")), "ticker", "date", "r", "b").select("ticker", *[r(c).alias(c) for c in ("beta", "alpha", "correlation", "tracking_error")])


@query(f"""WITH {RETURNS}, b AS (SELECT date, avg(r) AS b FROM ret GROUP BY 1), j AS (SELECT ticker, date_trunc('month', date) AS m, exp(sum(r)) - 1 AS x, exp(sum(b)) - 1 AS y FROM ret JOIN b USING (date) GROUP BY 1, 2)
SELECT ticker, round(avg(x) FILTER (WHERE y < 0) / avg(y) FILTER (WHERE y < 0), 6) AS downside_capture, round(avg(x) FILTER (WHERE y > 0) / avg(y) FILTER (WHERE y > 0), 6) AS upside_capture FROM j GROUP BY 1""")
def downside_capture(t):
    x = returns(t)
    return metrics.capture(x, x.groupBy("date").agg(F.avg("r").alias("b")), "ticker", "date", "r", "b").select("ticker", r("downside_capture").alias("downside_capture"), r("upside_capture").alias("upside_capture"))


@query(f"""WITH {_NAV} SELECT ticker, date, CASE WHEN count(*) OVER w = 12 THEN round(avg(r) OVER w / stddev_pop(r) OVER w * sqrt(252), 4) END AS rolling_sharpe, CASE WHEN count(*) OVER w = 12 THEN round(stddev_samp(r) OVER w * sqrt(252), 6) END AS rolling_volatility,
 CASE WHEN count(*) OVER w = 12 THEN round(nav / max(nav) OVER w - 1, 6) END AS rolling_drawdown FROM nav WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", dates="date")
def rolling_metrics(t):
    x = metrics.rolling(returns(t), "ticker", "date", "r", 12)
    return x.select("ticker", "date", r("rolling_sharpe", 4).alias("rolling_sharpe"), r("rolling_volatility").alias("rolling_volatility"), r("rolling_drawdown").alias("rolling_drawdown"))


@query(f"""WITH {RETURNS}, w(label, a, b) AS (VALUES ('first', DATE '1995-06-01', DATE '1996-06-01'), ('second', DATE '1997-01-01', DATE '1998-01-01')), j AS (SELECT label, ticker, date, r, exp(sum(r) OVER (PARTITION BY label, ticker ORDER BY date)) AS nav FROM ret JOIN w ON date > a AND date <= b),
d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY label, ticker ORDER BY date), 1.0) - 1 AS dd FROM j) SELECT ticker, label, count(*)::BIGINT AS n, round(exp(sum(r)) - 1, 6) AS cumulative, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(min(dd), 6) AS max_drawdown FROM d GROUP BY 1, 2""")
def crisis_windows(t):
    w = t.spark.createDataFrame([("first", "1995-06-01", "1996-06-01"), ("second", "1997-01-01", "1998-01-01")], "label string, start string, end string").select("label", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return metrics.window_metrics(returns(t), w, "ticker", "date", "r").select("ticker", "label", "n", *[r(c).alias(c) for c in ("cumulative", "volatility", "max_drawdown")])


@query(f"""WITH {RETURNS}, m AS (SELECT ticker, date, r - avg(r) OVER (PARTITION BY ticker) AS e FROM ret), p AS (SELECT ticker, e, e * lag(e, 1) OVER w AS p1, e * lag(e, 2) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, round((sum(e * e) + 2 * (1 - 1 / 3.0) * sum(p1) + 2 * (1 - 2 / 3.0) * sum(p2)) / count(*), 6) AS lrv FROM p GROUP BY 1""")
def newey_west(t):
    return metrics.newey_west(returns(t), "ticker", "date", "r", 2).select("ticker", r("lrv").alias("lrv"))


@query("""WITH m AS (SELECT l_partkey AS p, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, avg(l_extendedprice / l_quantity) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
x AS (SELECT p, m, v / lag(v, 12) OVER w - 1 AS mom FROM m WINDOW w AS (PARTITION BY p ORDER BY m)) SELECT m, p, round(mom, 6) AS mom FROM x WHERE mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m ORDER BY mom DESC, p) <= 5""", dates="m")
def momentum_topk(t):
    from tidemark.portfolio import momentum, top_by_signal

    month, price = F.to_date(F.trunc("l_shipdate", "month")), F.avg(F.col("l_extendedprice") / F.col("l_quantity"))
    panel = t.lineitem.groupBy(F.col("l_partkey").alias("ticker"), month.alias("date")).agg(price.alias("close"))
    x = momentum(panel, long=12, skip=0).where("signal IS NOT NULL")
    return top_by_signal(x, "date", "ticker", "signal", 5).select(F.col("date").alias("m"), F.col("ticker").alias("p"), r("signal").alias("mom"))


@query("""WITH e AS (SELECT user_id AS ticker, event_id AS i, CASE WHEN event_id % 13 = 0 THEN value * 100 ELSE value + 50 END AS close FROM events), n AS (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY i) / close AS rr FROM e),
f AS (SELECT *, CASE WHEN abs(rr / 100 - 1) <= 0.1 THEN 1 WHEN abs(rr * 100 - 1) <= 0.1 THEN -1 ELSE 0 END AS fl FROM n), s AS (SELECT *, sum(fl) OVER (PARTITION BY ticker ORDER BY i DESC) AS pw FROM f)
SELECT ticker, i, CASE WHEN abs(pw) <= 1 THEN power(100.0, pw) ELSE 1.0 END AS unit_factor FROM s""")
def unit_factor(t):
    e = t.events.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("i"), F.when(F.col("event_id") % 13 == 0, F.col("value") * 100).otherwise(F.col("value") + 50).alias("close"))
    return prices.unit_factors(e, order="i").select("ticker", "i", "unit_factor")


@query()
def spike_flag(t):
    e = t.events.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("i"), F.when(F.col("event_id") % 17 == 0, F.col("value") * 3).otherwise(100 + F.col("value") / 50).alias("close"))
    return prices.spike_days(e, order="i").where("spike").select("ticker", "i")


def _month_ends(p):
    """The last trading day of each month."""
    return p.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("asof")).select("asof")


@query(f"""WITH {DENSE}, g AS (SELECT ticker, d.date FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) t JOIN (SELECT DISTINCT date FROM bars) d ON d.date BETWEEN a AND b),
 h AS (SELECT ticker, date, close, volume, close / lag(close) OVER w - 1 AS ret FROM g LEFT JOIN bars USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date)), d AS (SELECT DISTINCT date FROM bars), a AS (SELECT max(date) AS as_of FROM d GROUP BY date_trunc('month', date)), c AS (SELECT as_of, date, row_number() OVER (PARTITION BY as_of ORDER BY date DESC) - 1 AS k FROM d JOIN a ON date <= as_of),
t AS (SELECT h.*, k, as_of FROM h JOIN c USING (date) WHERE k < 300), f AS (SELECT CAST(as_of AS VARCHAR) AS as_of, ticker, max(k) AS top, round(max(close) FILTER (WHERE k = 0) / max(close) FILTER (WHERE k = 21) - 1, 6) AS mom_1m, round(max(close) FILTER (WHERE k = 21) / max(close) FILTER (WHERE k = 252) - 1, 6) AS mom_12_1,
 round(max(close) FILTER (WHERE k = 0) / max(close) FILTER (WHERE k < 252) - 1, 6) AS dist_52w_high, round(avg(close) FILTER (WHERE k < 50) / avg(close) FILTER (WHERE k < 200) - 1, 6) AS ma_ratio_50_200, round(regr_r2(ln(close), -k) FILTER (WHERE k < 126), 6) AS trend_r2_6m,
 round(stddev_samp(ret) FILTER (WHERE k < 63) * sqrt(252), 6) AS vol_3m, round(skewness(ret) FILTER (WHERE k < 126), 6) AS ret_skew_6m, round(kurtosis(ret) FILTER (WHERE k < 126), 6) AS ret_kurt_6m, round(quantile_cont(ret, 0.05) FILTER (WHERE k < 252), 6) AS var_95_12m,
 round(avg(volume) FILTER (WHERE k < 5) / avg(volume) FILTER (WHERE k < 60), 6) AS volume_shock FROM t GROUP BY 1, 2 HAVING count(close) FILTER (WHERE k < 252) >= 0.9 * 252)
SELECT * EXCLUDE (top) FROM f QUALIFY count(*) OVER (PARTITION BY as_of) >= 2 AND max(top) OVER (PARTITION BY as_of) >= 299""")
def features_raw(t):
    from tidemark import features

    p = features.on_calendar(dense(t).withColumn("raw", F.col("close")))
    out = features.features(p, _month_ends(p))
    return out.select(F.date_format("asof", "yyyy-MM-dd").alias("as_of"), "ticker", *[r(c).alias(c) for c in ("mom_1m", "mom_12_1", "dist_52w_high", "ma_ratio_50_200", "trend_r2_6m", "vol_3m", "ret_skew_6m", "ret_kurt_6m", "var_95_12m", "volume_shock")])


@query()
def feature_panel(t):
    from tidemark import features

    p = dense(t).withColumn("adj_close", F.col("close"))
    f = features.feature_panel(p, _month_ends(p))
    return f.select(F.date_format("asof", "yyyy-MM-dd").alias("asof"), "ticker", *[r(c).alias(c) for c in features.FEATURES])


_MONTHLY = """px AS (SELECT p_brand AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _months(t):
    """Every month of the table."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker"), F.to_date(F.trunc("l_shipdate", "month")).alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


@query(f"""WITH {_MONTHLY}, rets AS (SELECT ticker, date, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS r FROM px), n AS (SELECT date AS rebalance, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM px WHERE month(date) = 1),
d AS (SELECT rebalance, lead(rebalance) OVER (ORDER BY rebalance) AS nxt FROM (SELECT DISTINCT rebalance FROM n)), s AS (SELECT x.date, d.* FROM (SELECT DISTINCT date FROM px) x JOIN d ON x.date > rebalance AND (nxt IS NULL OR x.date <= nxt)),
h AS (SELECT s.rebalance, s.nxt, s.date, n.ticker, weight * exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY s.rebalance, n.ticker ORDER BY s.date)) AS v FROM s JOIN n ON n.rebalance = s.rebalance LEFT JOIN rets ON rets.ticker = n.ticker AND rets.date = s.date),
b AS (SELECT rebalance, date, sum(v) AS pv FROM h GROUP BY 1, 2), g AS (SELECT rebalance, date, pv / coalesce(lag(pv) OVER (PARTITION BY rebalance ORDER BY date), 1.0) - 1 AS gross FROM b),
e AS (SELECT h.nxt AS rebalance, ticker, v / pv AS drifted FROM h JOIN b USING (rebalance, date) WHERE h.date = h.nxt), u AS (SELECT rebalance, sum(abs(coalesce(weight, 0) - coalesce(drifted, 0))) AS turnover FROM n FULL JOIN e USING (rebalance, ticker) GROUP BY 1),
z AS (SELECT date, gross FROM g UNION ALL SELECT min(rebalance), 0 FROM n)
SELECT z.date, round(ln(1 + gross - coalesce(turnover * 0.001, 0)), 6) AS log_return, round(turnover, 6) AS turnover FROM z LEFT JOIN u ON u.rebalance = z.date""", dates="date")
def portfolio_drift(t):
    from tidemark import portfolio

    px = _months(t)
    n = portfolio.equal_targets(px.where(F.month("date") == 1)).withColumnRenamed("date", "rebalance")
    s = portfolio.simulate(n, px)
    return s["returns"].join(s["turnover"].withColumnRenamed("rebalance", "date"), "date", "left").select("date", r("log_return").alias("log_return"), r("turnover").alias("turnover"))


@query(f"""WITH {_MONTHLY}, s AS (SELECT *, CASE WHEN count(*) OVER a = 3 AND count(*) OVER b = 9 THEN CASE WHEN avg(close) OVER a > avg(close) OVER b THEN 1 ELSE 0 END ELSE 0 END AS s, close / lag(close) OVER w - 1 AS r FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT ticker, date, coalesce(lag(s) OVER w, 0) AS position, round(coalesce(lag(s) OVER w, 0) * coalesce(r, 0), 6) + 0.0 AS strategy_return FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)""", dates="date")
def golden_cross(t):
    from tidemark import portfolio

    return portfolio.golden_cross(_months(t), 3, 9).select("ticker", "date", "position", r("strategy_return").alias("strategy_return"))


def _estimates(t, method):
    from tidemark import portfolio

    w = Window.partitionBy("ticker").orderBy("date")
    x = _months(t).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).where("ret IS NOT NULL")
    d = x.select(F.col("date").alias("d")).distinct().where(F.month("d") == 1)
    rows = x.join(F.broadcast(d), (F.col("date") <= F.col("d")) & (F.months_between("d", "date") < 24)).select(F.col("d").alias("date"), F.round(F.months_between("d", "date")).cast("int").alias("k"), "ticker", "ret")
    return portfolio.estimate_targets(rows, method, 0.0, 0.2).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "ticker", r("weight").alias("weight"))


@query()
def hrp_weights(t):
    return _estimates(t, "hrp")


@query()
def mvo_min_variance(t):
    return _estimates(t, "min_variance")


@query()
def mvo_max_sharpe(t):
    return _estimates(t, "max_sharpe")


@query(f"""WITH {_MONTHLY}, f AS (SELECT ticker, date, close / lag(close, 3) OVER w - 1 AS s, lead(close, 3) OVER w / close - 1 AS y FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS b FROM f WHERE s IS NOT NULL AND y IS NOT NULL)
SELECT date, round(corr(a, b), 6) AS ic, count(*)::BIGINT AS n FROM k GROUP BY 1""", dates="date")
def rank_ic(t):
    from tidemark import features

    px = _months(t)
    w = Window.partitionBy("ticker").orderBy("date")
    s = px.select("ticker", "date", (F.try_divide(F.col("close"), F.lag("close", 3).over(w)) - 1).alias("s"))
    f = s.join(features.forward_returns(px, 3), ["ticker", "date"])
    return features.rank_ic(f, "date", "s", "fwd").select("date", r("ic").alias("ic"), "n")
