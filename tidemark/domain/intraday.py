"""Minute bars: session hours, resampling, checks against daily prices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import col

OPEN_MINUTE = 9 * 60 + 30
NY = "America/New_York"


def new_york(ts) -> Column:
    return F.from_utc_timestamp(col(ts), NY)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def close_minute(day: Column) -> Column:
    """Minute of the close in New York: 16:00, and 13:00 on July 3, December 24 and the Friday after Thanksgiving."""
    m, d, wd = F.month(day), F.dayofmonth(day), F.weekday(day)
    early = ((m == 7) & (d == 3)) | ((m == 12) & (d == 24)) | ((m == 11) & (wd == 4) & d.between(23, 29))
    return F.when(early & (wd < 5), 13 * 60).otherwise(16 * 60)


def regular_hours(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Bars from 09:30 to the minute of the closing auction."""
    local = new_york(ts)
    return bars.where(minute_of_day(local).between(F.lit(OPEN_MINUTE), close_minute(local)))


def resample(bars: DataFrame, minutes: int, by=("ticker",), ts: str = "ts") -> DataFrame:
    """Bars of `minutes` from the open; the auction's minute belongs to the session's last bar. VWAP is by volume, or the mean without any."""
    local = new_york(ts)
    m = minute_of_day(local)
    since = F.when(m == close_minute(local), m - OPEN_MINUTE - 1).otherwise(m - OPEN_MINUTE)
    start = F.floor(since / minutes) * minutes + OPEN_MINUTE
    bucket = F.to_utc_timestamp(F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(0), start.cast("int"), F.lit(0)), NY)
    rows = bars.withColumn("__bucket", bucket)
    out = rows.groupBy(*by, "__bucket").agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.sum(F.col("vwap") * F.col("volume")).alias("__pv"), F.avg("vwap").alias("__mean"))
    vwap = F.when(F.col("volume") > 0, F.col("__pv") / F.col("volume")).otherwise(F.col("__mean"))
    return out.select(*by, F.col("__bucket").alias(ts), "open", "high", "low", "close", "volume", vwap.alias("vwap"), "trade_count")


def flag_deviations(days: DataFrame, price_tol: float = 0.02, volume_tol: float = 0.15) -> DataFrame:
    """Daily sums of minutes beside daily prices: high or low off by price_tol, or the volume ratio off the ticker's own median."""
    ratio = F.when(F.col("d_volume") > 0, F.col("i_volume") / F.col("d_volume"))
    out = days.withColumn("high_dev", F.abs(F.try_divide("i_high", "d_high") - 1)).withColumn("low_dev", F.abs(F.try_divide("i_low", "d_low") - 1)).withColumn("volume_ratio", ratio)
    out = out.withColumn("median_ratio", F.median("volume_ratio").over(Window.partitionBy("ticker")))
    out = out.withColumn("volume_dev", F.abs(F.try_divide("volume_ratio", "median_ratio") - 1))
    over = (F.col("high_dev") > price_tol) | (F.col("low_dev") > price_tol) | (F.col("volume_dev") > volume_tol)
    return out.withColumn("flagged", F.coalesce(over, F.lit(False)))


def against_daily(minutes: DataFrame, daily: DataFrame) -> DataFrame:
    """Session sums of minute bars joined with daily bars (ticker, date, high, low, volume), deviations flagged."""
    hours = regular_hours(minutes)
    sums = hours.groupBy("ticker", F.to_date(new_york("ts")).alias("date")).agg(F.max("high").alias("i_high"), F.min("low").alias("i_low"), F.sum("volume").alias("i_volume"))
    d = daily.select("ticker", "date", F.col("high").alias("d_high"), F.col("low").alias("d_low"), F.col("volume").alias("d_volume"))
    return flag_deviations(sums.join(d, ["ticker", "date"]))


def merge_minutes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new minutes with one row for each (ticker, ts): the new one counts."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("ticker", "ts")]
    return both.groupBy("ticker", "ts").agg(F.max_by(F.struct(*rest), "__new").alias("r")).select("ticker", "ts", *[F.col(f"r.{c}").alias(c) for c in rest if c != "__new"])


def write_minutes(bars: DataFrame, path: str, intervals=(5, 10, 60)) -> None:
    """Minutes and derived bars by interval, ticker and year; only partitions that occur in bars are replaced."""
    def put(df: DataFrame, name: str):
        df.withColumn("year", F.year(new_york("ts"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("ticker", "year").parquet(f"{path}/{name}")

    put(bars, "1m")
    hours = regular_hours(bars)
    for n in intervals:
        put(resample(hours, n), "1h" if n == 60 else f"{n}m")
