"""Return, risk and drawdown measures of return series (key, date, value)."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list, col, quantile, ratio
from tidemark.operators.windows import islands

DAYS = 252
#: The 5 % point of the normal distribution and its density there.
Z05, PHI05 = -1.6448536269514729, 0.10313564037537139


# aggregates over log returns r, f periods a year
def cumulative_return(r) -> Column:
    return F.exp(F.sum(col(r))) - 1


def annualized_return(r, f: int = DAYS) -> Column:
    return F.exp(F.avg(col(r)) * f) - 1


def arith_annualized_return(r, f: int = DAYS) -> Column:
    return F.avg(col(r)) * f


def annualized_volatility(r, f: int = DAYS) -> Column:
    return F.stddev_samp(col(r)) * math.sqrt(f)


def value_at_risk(r, q: float = 0.05) -> Column:
    return quantile(F.expm1(col(r)), q)


def with_nav(df: DataFrame, by, order: str, r: str, log: bool = True) -> DataFrame:
    """df with nav (1 before the first return), its drawdown against the running peak, 1 among them."""
    w = Window.partitionBy(*_list(by)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col(r) if log else F.log1p(F.col(r))
    out = df.withColumn("nav", F.exp(F.sum(step).over(w)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)


def conditional_value_at_risk(df: DataFrame, by, r: str, q: float = 0.05) -> DataFrame:
    """(by, var, cvar): the quantile of simple returns and the mean of those at or below it."""
    x = df.withColumn("__x", F.expm1(F.col(r)))
    var = x.groupBy(*_list(by)).agg(quantile("__x", q).alias("var"))
    return x.join(var, _list(by)).groupBy(*_list(by)).agg(F.first("var").alias("var"), F.avg(F.when(F.col("__x") <= F.col("var"), F.col("__x"))).alias("cvar"))


def drawdown_summary(df: DataFrame, by, order: str, r: str) -> DataFrame:
    """(by, max_drawdown, ulcer_index, max_duration): depth, root mean square, and longest run of rows below the peak."""
    by = _list(by)
    d = with_nav(df, by, order, r)
    depth = d.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"))
    runs = islands(d.withColumn("__under", F.col("drawdown") < -1e-12), "__under", by, order).where("__under").groupBy(*by, "island").agg(F.count("*").alias("n"))
    return depth.join(runs.groupBy(*by).agg(F.max("n").alias("n")), by, "left").select(*by, "max_drawdown", "ulcer_index", F.coalesce("n", F.lit(0)).alias("max_duration"))


def performance(df: DataFrame, by, order: str, r: str, rf: str | None = None, f: int = DAYS) -> DataFrame:
    """(by, ...): return, volatility, Sharpe, Sortino, Calmar, win rate and moments of log returns, rf by row or zero."""
    by = _list(by)
    x = df.withColumn("__e", F.col(r) - (F.col(rf) if rf else F.lit(0.0)))
    down = F.sqrt(F.avg(F.pow(F.least(F.col("__e"), F.lit(0.0)), 2)))
    g = x.groupBy(*by).agg(
        F.count(r).alias("n"), cumulative_return(r).alias("cumulative"), annualized_return(r, f).alias("annual_return"), annualized_volatility(r, f).alias("volatility"),
        (ratio(F.avg("__e"), F.stddev_samp("__e")) * math.sqrt(f)).alias("sharpe"), (ratio(F.avg("__e"), down) * math.sqrt(f)).alias("sortino"),
        F.avg((F.col(r) > 0).cast("double")).alias("win_rate"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"),
        ratio(F.sum(F.when(F.col(r) > 0, F.col(r))), -F.sum(F.when(F.col(r) < 0, F.col(r)))).alias("profit_factor"),
        ratio(quantile(r, 0.95), F.abs(quantile(r, 0.05))).alias("tail_ratio"),
        F.max_by(order, F.struct(r, order)).alias("best_day"), F.min_by(order, F.struct(r, order)).alias("worst_day"),
        (F.avg(r) + Z05 * F.stddev_samp(r)).alias("var_parametric"), (F.avg(r) - PHI05 / 0.05 * F.stddev_samp(r)).alias("cvar_parametric"))
    return g.join(drawdown_summary(df, by, order, r), by).withColumn("calmar", ratio("annual_return", F.abs("max_drawdown")))


def against_benchmark(df: DataFrame, bench: DataFrame, by, order: str, r: str, b: str, rf: float = 0.0) -> DataFrame:
    """(by, beta, alpha, r2, correlation, tracking_error, information_ratio) over common dates."""
    by = _list(by)
    j = df.join(bench.select(order, F.col(b).alias("__b")), order).withColumn("__d", F.col(r) - F.col("__b"))
    g = j.groupBy(*by).agg(F.covar_samp(r, "__b").alias("c"), F.var_samp("__b").alias("v"), F.avg(r).alias("m"), F.avg("__b").alias("mb"), F.corr(r, "__b").alias("correlation"),
                           (F.stddev_samp("__d") * math.sqrt(DAYS)).alias("tracking_error"), (ratio(F.avg("__d"), F.stddev_samp("__d")) * math.sqrt(DAYS)).alias("information_ratio"))
    g = g.withColumn("beta", ratio("c", "v"))
    return g.select(*by, "beta", (((F.col("m") - rf) - F.col("beta") * (F.col("mb") - rf)) * DAYS).alias("alpha"), "correlation", "tracking_error", "information_ratio")


def capture(df: DataFrame, bench: DataFrame, by, day: str, r: str, b: str) -> DataFrame:
    """Mean monthly return in months when the benchmark fell (and rose), over the benchmark's."""
    by = _list(by)
    j = df.join(bench.select(day, F.col(b).alias("__b")), day).groupBy(*by, F.trunc(day, "month").alias("month")).agg((F.exp(F.sum(r)) - 1).alias("x"), (F.exp(F.sum("__b")) - 1).alias("y"))
    side = lambda cond: ratio(F.avg(F.when(cond, F.col("x"))), F.avg(F.when(cond, F.col("y"))))
    return j.groupBy(*by).agg(side(F.col("y") < 0).alias("downside_capture"), side(F.col("y") > 0).alias("upside_capture"))


def rolling(df: DataFrame, by, order: str, r: str, n: int = DAYS) -> DataFrame:
    """df with rolling_sharpe (population deviation), rolling_volatility and rolling_drawdown over n rows; null before n."""
    w = Window.partitionBy(*_list(by)).orderBy(order)
    last = w.rowsBetween(-(n - 1), 0)
    full = F.count(r).over(last) >= n
    nav = with_nav(df, by, order, r)
    return nav.select(*df.columns, F.when(full, ratio(F.avg(r).over(last), F.stddev_pop(r).over(last)) * math.sqrt(DAYS)).alias("rolling_sharpe"),
                      F.when(full, F.stddev_samp(r).over(last) * math.sqrt(DAYS)).alias("rolling_volatility"), F.when(full, F.col("nav") / F.max("nav").over(last) - 1).alias("rolling_drawdown"))


def streaks(df: DataFrame, by, order: str, r: str) -> DataFrame:
    """(by, longest_win, longest_loss): runs of rows above and below zero."""
    by = _list(by)
    runs = islands(df.withColumn("__s", F.signum(r)), "__s", by, order).groupBy(*by, "island").agg(F.first("__s").alias("s"), F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("s") > 0, F.col("n"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(F.col("s") < 0, F.col("n"))), F.lit(0)).alias("longest_loss"))


def period_returns(df: DataFrame, by, day: str, r: str, unit: str) -> DataFrame:
    return df.groupBy(*_list(by), F.trunc(day, unit).alias("period")).agg((F.exp(F.sum(r)) - 1).alias("ret"))


def month_table(df: DataFrame, day: str, r: str) -> DataFrame:
    """Years as rows, months 1 to 12 as columns m1 to m12."""
    m = df.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg((F.exp(F.sum(r)) - 1).alias("ret"))
    p = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return p.select("year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def window_metrics(df: DataFrame, windows: DataFrame, by, order: str, r: str) -> DataFrame:
    """(by, label, n, cumulative, volatility, max_drawdown) in each half-open window (start, end]; null below two rows.

    windows (label, start, end) are the episodes under study, a short list; each row is matched by date.
    """
    by = _list(by)
    j = df.join(F.broadcast(windows), (F.col(order) > F.col("start")) & (F.col(order) <= F.col("end")))
    d = with_nav(j, [*by, "label"], order, r)
    some = F.count(r) >= 2
    return d.groupBy(*by, "label").agg(F.count(r).alias("n"), F.when(some, cumulative_return(r)).alias("cumulative"), F.when(some, annualized_volatility(r)).alias("volatility"), F.when(some, F.min("drawdown")).alias("max_drawdown"))


def bill_yield(discount, days: int = 91) -> Column:
    """Annual yield of a bill from its percent discount rate."""
    d = col(discount) / 100
    return 365 * d / (360 - days * d)


def rf_period(y, periods: int) -> Column:
    return F.log1p(col(y)) / periods


def newey_west(df: DataFrame, by, order: str, x: str, lags: int) -> DataFrame:
    """(by, lrv): long-run variance of x with Bartlett weights."""
    by = _list(by)
    w = Window.partitionBy(*by).orderBy(order)
    m = df.withColumn("__e", F.col(x) - F.avg(x).over(Window.partitionBy(*by)))
    for j in range(1, lags + 1):
        m = m.withColumn(f"__p{j}", F.col("__e") * F.lag("__e", j).over(w))
    total = F.sum(F.col("__e") * F.col("__e"))
    for j in range(1, lags + 1):
        total = total + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"__p{j}"), F.lit(0.0))
    return m.groupBy(*by).agg((total / F.count("__e")).alias("lrv"))
