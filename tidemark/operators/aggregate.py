"""Resampling, pivots, pairwise statistics and allocations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list, col


def bars(df: DataFrame, by, ts: str, price: str, volume: str, width: str, offset: str | None = None, tie=()) -> DataFrame:
    """Open, high, low, close, volume, count and VWAP of each window; ties in time are ordered by `tie`."""
    order = F.struct(ts, *_list(tie))
    win = F.window(F.col(ts), width, width, offset) if offset else F.window(F.col(ts), width)
    g = df.groupBy(*_list(by), win.alias("__w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"), F.count("*").alias("n"), F.sum(col(price) * col(volume)).alias("__pv"), F.avg(price).alias("__mean"))
    vwap = F.when(F.col("volume") > 0, F.col("__pv") / F.col("volume")).otherwise(F.col("__mean"))
    return g.select(*_list(by), F.col("__w.start").alias("bar"), "open", "high", "low", "close", "volume", "n", vwap.alias("vwap"))


def calendar(df: DataFrame, by, day: str, unit: str, value: str, how: str = "last") -> DataFrame:
    """One value a calendar period: last (by day) or compound (of simple returns)."""
    agg = F.max_by(value, day) if how == "last" else F.product(1 + col(value)) - 1
    return df.groupBy(*_list(by), F.trunc(day, unit).alias("period")).agg(agg.alias(value))


def pair_stats(df: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """corr and covar_samp of every pair of series (a < b) over their common days: an equi-join on the day, then one aggregate.

    Work grows with the square of the number of series, not of the rows of one.
    """
    a = df.select(F.col(day), F.col(by).alias("a"), F.col(value).alias("x"))
    b = df.select(F.col(day), F.col(by).alias("b"), F.col(value).alias("y"))
    return a.join(b, day).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))


def transpose(df: DataFrame, key: str, items: list[str], periods: list) -> DataFrame:
    """Items as rows and periods as columns; items that are null throughout are left out."""
    long = df.unpivot([key], items, "item", "value").where("value IS NOT NULL")
    return long.groupBy("item").pivot(key, periods).agg(F.first("value"))


def top_and_other(df: DataFrame, c: str, k: int = 3, other: str = "Other") -> DataFrame:
    """Counts of the k commonest values, the rest as one row; ties by value."""
    n = df.groupBy(c).agg(F.count("*").alias("n"))
    r = n.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last(c))))
    return r.groupBy(F.when(F.col("__r") <= k, F.col(c)).otherwise(F.lit(other)).alias(c)).agg(F.sum("n").alias("n"))


def allocate(counts: dict[str, int], budget: int) -> dict[str, int]:
    """Shares a budget evenly; who needs less than an even share gets it all, and the rest is shared again among the others."""
    out, left = {k: 0 for k in counts}, sorted(((n, k) for k, n in counts.items() if n > 0))
    while left and budget > 0:
        n, k = left[0]
        share = budget // len(left)
        if n <= share:
            out[k], budget, left = n, budget - n, left[1:]
            continue
        extra = budget - share * len(left)
        for i, (_, k) in enumerate(left):
            out[k] = share + (i < extra)
        break
    return out
