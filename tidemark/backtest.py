"""The record of a backtest: one row of return, risk, drawdown, tail and period measures for each series of levels."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list, kurt_pop, quantile, ratio, skew_pop
from tidemark.metrics import DAYS, PHI05, Z05, streaks
from tidemark.operators.windows import islands

#: Annual rate where no bill series is there, and days in a year.
RF_FALLBACK, YEAR_DAYS = 0.04, 365.25


def rf_rate(macro: DataFrame, series: list[str], day: str = "date", start=None, end=None) -> DataFrame:
    """(rf_rate): the mean of the first series (percent a year) with a value between start and end, else the fallback."""
    x = macro
    if start is not None:
        x = x.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        x = x.where(F.col(day) <= F.lit(end).cast("date"))
    return x.agg(F.coalesce(*[F.avg(s) / 100 for s in series], F.lit(RF_FALLBACK)).alias("rf_rate"))


def steps(levels: DataFrame, by, day: str, level: str) -> DataFrame:
    """(by, day, nav, ret, drawdown): simple returns, null on the first day, and drawdowns; days without a level are left out."""
    by = _list(by)
    w = Window.partitionBy(*by).orderBy("day")
    x = levels.where(F.col(level).isNotNull()).select(*by, F.col(day).alias("day"), F.col(level).cast("double").alias("nav"))
    high = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("ret", ratio("nav", F.lag("nav").over(w)) - 1).withColumn("drawdown", ratio("nav", high) - 1)


def drawdown_days(x: DataFrame, by) -> DataFrame:
    """(by, max, avg and current dd_duration_days): calendar days from an episode's first day below the peak to its last.

    Zero without any episode; the current one is that which holds the last day.
    """
    by = _list(by)
    runs = islands(x.withColumn("under", F.col("drawdown") < 0), "under", by, "day").groupBy(*by, "island").agg(
        F.first("under").alias("under"), F.datediff(F.max("day"), F.min("day")).alias("days"), F.max("day").alias("end"))
    below = F.when(F.col("under"), F.col("days"))
    return runs.groupBy(*by).agg(
        F.coalesce(F.max(below), F.lit(0)).alias("max_dd_duration_days"), F.coalesce(F.avg(below), F.lit(0.0)).alias("avg_dd_duration_days"),
        F.max_by(F.coalesce(below, F.lit(0)), "end").alias("current_dd_duration_days"))


def period_extremes(x: DataFrame, by, unit: str) -> DataFrame:
    """(by, best_<unit>, worst_<unit> and their last calendar days); a period counts with one return at least, the earliest of ties."""
    by = _list(by)
    p = x.groupBy(*by, F.to_date(F.trunc("day", unit)).alias("period")).agg(
        F.min_by("nav", "day").alias("first"), F.max_by("nav", "day").alias("last"), F.count("ret").alias("n"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy(*by).orderBy("period")), "first")
    months = {"month": 1, "year": 12}[unit]
    p = p.withColumn("value", ratio("last", before) - 1).where("n > 0 AND value IS NOT NULL").withColumn("ends", F.date_sub(F.add_months("period", months), 1))
    return p.groupBy(*by).agg(
        F.max("value").alias(f"best_{unit}"), F.min_by("ends", F.struct(-F.col("value"), "ends")).alias(f"best_{unit}_date"),
        F.min("value").alias(f"worst_{unit}"), F.min_by("ends", F.struct("value", "ends")).alias(f"worst_{unit}_date"))


def backtest_record(levels: DataFrame, by, day: str, level: str, rf_annual: float = RF_FALLBACK, f: int = DAYS, confidence: float = 0.95) -> DataFrame:
    """One row for each series of (by, day, level): all measures of a backtest. Ratios with a zero denominator are null.

    Returns are simple and between the days that are there. The parametric tail is at 95 %, whatever `confidence` is.
    """
    by, tail = _list(by), 1 - confidence
    x = steps(levels, by, day, level)
    rf = (1 + rf_annual) ** (1 / f) - 1
    ret, year = F.col("ret"), F.datediff(F.max("day"), F.min("day")) / F.lit(YEAR_DAYS)
    semi = lambda least: F.sqrt(F.avg(F.when(ret < least, ret * ret))) * math.sqrt(f)
    losses, gains = F.sum(F.when(ret < 0, -ret)), F.sum(F.when(ret > 0, ret))
    best, worst = F.struct(-ret, "day"), F.struct("ret", "day")
    known = F.when(ret.isNotNull(), F.col("day"))
    g = x.groupBy(*by).agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("ret").alias("n_days"), year.alias("n_years"),
        (ratio(F.max_by("nav", "day"), F.min_by("nav", "day")) - 1).alias("total_return"),
        (F.stddev_samp("ret") * math.sqrt(f)).alias("annual_volatility"), F.coalesce(semi(0.0), F.lit(0.0)).alias("downside_deviation"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))).alias("avg_drawdown"),
        (ratio(F.avg(ret - rf), F.stddev_samp("ret")) * math.sqrt(f)).alias("sharpe_ratio"), ratio(F.avg(ret - rf) * f, semi(rf)).alias("sortino_ratio"),
        quantile("ret", tail).alias("var_historical"), (F.avg("ret") + Z05 * F.stddev_samp("ret")).alias("var_parametric"),
        (F.avg("ret") - PHI05 / 0.05 * F.stddev_samp("ret")).alias("cvar_parametric"), skew_pop("ret").alias("skewness"), kurt_pop("ret").alias("excess_kurtosis"),
        ratio(quantile("ret", 0.95), F.abs(quantile("ret", 0.05))).alias("tail_ratio"), F.avg((ret > 0).cast("double")).alias("win_rate"),
        ratio(gains, losses).alias("profit_factor"), F.max("ret").alias("best_day"), F.min_by(known, F.when(ret.isNotNull(), best)).alias("best_day_date"),
        F.min("ret").alias("worst_day"), F.min_by(known, F.when(ret.isNotNull(), worst)).alias("worst_day_date"))
    g = g.withColumn("cagr", F.when(F.col("n_years") > 0, F.pow(1 + F.col("total_return"), ratio(F.lit(1.0), "n_years")) - 1))
    g = g.withColumn("recovery_factor", ratio("total_return", F.abs("max_drawdown"))).withColumn("rf_rate_used", F.lit(float(rf_annual)))
    shortfall = x.join(g.select(*by, "var_historical"), by).where(ret <= F.col("var_historical") + 1e-12).groupBy(*by).agg(F.avg("ret").alias("cvar_historical"))
    out = g.join(shortfall, by, "left").join(drawdown_days(x, by), by, "left")
    for unit in ("month", "year"):
        out = out.join(period_extremes(x, by, unit), by, "left")
    runs = streaks(x.where("ret IS NOT NULL"), by, "day", "ret").withColumnsRenamed({"longest_win": "max_consecutive_wins", "longest_loss": "max_consecutive_losses"})
    return out.join(runs, by, "left")
