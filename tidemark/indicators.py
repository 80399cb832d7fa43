"""Thirty technical indicators for each key's own calendar."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio

YEAR = 252


class Frames:
    """Windows of one key and order, with null until a frame is full."""

    def __init__(self, by: str, order: str):
        self.w = Window.partitionBy(by).orderBy(order)

    def last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, fn, c: Column, n: int, least: int | None = None) -> Column:
        return F.when(F.count(c).over(self.last(n)) >= (n if least is None else least), fn(c).over(self.last(n)))

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def cum(self, c: Column) -> Column:
        return F.sum(c).over(self.w.rowsBetween(Window.unboundedPreceding, 0))

    def weighted(self, c: Column, weights: list[float]) -> Column:
        """Weighted mean of the last values, the last weight for the latest."""
        n = len(weights)
        terms = [F.lag(c, n - 1 - i).over(self.w) * F.lit(float(x)) if i < n - 1 else c * F.lit(float(x)) for i, x in enumerate(weights)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total / float(sum(weights))


def window_indicators(df: DataFrame, by: str = "ticker", order: str = "date") -> DataFrame:
    """df (open, high, low, close, volume) with every indicator that frames of rows can express.

    Values derived from windows are columns of a first projection, so that a second one can run windows over them; both use
    one partitioning, so there is one shuffle.
    """
    f = Frames(by, order)
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    ret, tp, mid = ratio(c, f.lag(c)) - 1, (h + l + c) / 3, (h + l) / 2
    prev = f.lag(c)
    sma20, sd20 = f.full(F.avg, c, 20), f.full(F.stddev_samp, c, 20)
    lo14, hi14 = f.full(F.min, l, 14), f.full(F.max, h, 14)
    a = df.select("*", ret.alias("return_1d"), F.when(prev > 0, F.ln(F.when(c > 0, c / prev))).alias("log_return"),
                  f.full(F.avg, c, 50).alias("sma_50"), f.full(F.avg, c, 200).alias("sma_200"), sma20.alias("bb_mid"), (sma20 + 2 * sd20).alias("bb_upper"), (sma20 - 2 * sd20).alias("bb_lower"),
                  f.weighted(c, list(range(1, 21))).alias("wma_20"), f.weighted(c, [1, 2, 2, 1]).alias("swma_4"),
                  F.max(c).over(f.last(YEAR)).alias("high_252d"), F.min(c).over(f.last(YEAR)).alias("low_252d"),
                  (100 * ratio(c - f.lag(c, 14), f.lag(c, 14))).alias("roc_14"), (100 * ratio(c - lo14, hi14 - lo14)).alias("stoch_k"), (-100 * ratio(hi14 - c, hi14 - lo14)).alias("williams_r"),
                  (f.full(F.avg, mid, 5) - f.full(F.avg, mid, 34)).alias("awesome"), F.greatest(h - l, F.abs(h - prev), F.abs(l - prev)).alias("true_range"),
                  F.pow(100 * ratio(c - f.full(F.max, c, 14, 1), f.full(F.max, c, 14, 1)), 2).alias("__dd2"), tp.alias("__tp"), f.lag(tp).alias("__tp1"), F.signum(c - prev).alias("__sign"))
    flow = F.col("__tp") * v
    pos, neg = F.when(F.col("__tp") > F.col("__tp1"), flow).otherwise(0.0), F.when(F.col("__tp") < F.col("__tp1"), flow).otherwise(0.0)
    mean_tp = F.avg("__tp").over(f.last(20))
    dev = F.aggregate(F.collect_list("__tp").over(f.last(20)), F.lit(0.0), lambda s, x: s + F.abs(x - mean_tp)) / 20
    pos14, neg14 = f.full(F.sum, pos, 14), f.full(F.sum, neg, 14)
    b = a.select("*", (f.full(F.stddev_samp, F.col("return_1d"), 20) * np.sqrt(YEAR)).alias("volatility_20d"), F.when(F.col("sma_200").isNotNull(), c > F.col("sma_200")).alias("above_sma200"),
                 f.full(F.avg, F.col("stoch_k"), 3).alias("stoch_d"), F.sqrt(f.full(F.avg, F.col("__dd2"), 14)).alias("ulcer_14"), (c / F.col("high_252d") - 1).alias("drawdown"),
                 f.cum(F.coalesce(F.col("return_1d") * v, F.lit(0.0))).alias("pvt"), f.cum(F.coalesce(F.col("__sign") * v, F.lit(0.0))).alias("obv"),
                 F.when(F.count("__tp").over(f.last(20)) >= 20, ratio(F.col("__tp") - mean_tp, 0.015 * dev)).alias("cci_20"),
                 F.when(neg14 > 0, 100 - 100 / (1 + pos14 / neg14)).when(pos14.isNotNull() & (pos14 > 0), 100.0).alias("mfi_14"))
    return b.drop("__dd2", "__tp", "__tp1", "__sign")


def _psar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse: the stop nears the extreme of the trend by a growing factor and flips when it is crossed."""
    n = len(high)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    rising, factor, extreme, stop = True, step, high[0], low[0]
    out[0] = stop
    for i in range(1, n):
        stop = stop + factor * (extreme - stop)
        if rising:
            stop = min(stop, low[i - 1], low[max(0, i - 2)])
            crossed = low[i] < stop
        else:
            stop = max(stop, high[i - 1], high[max(0, i - 2)])
            crossed = high[i] > stop
        if crossed:
            stop, rising, factor = extreme, not rising, step
            extreme = high[i] if rising else low[i]
        else:
            better = high[i] > extreme if rising else low[i] < extreme
            if better:
                extreme = high[i] if rising else low[i]
                factor = min(most, factor + step)
        out[i] = stop
    return out


def recursive_indicators(df: DataFrame, by: str = "ticker", order: str = "date") -> DataFrame:
    """df with ema_20, macd, macd_signal, macd_hist, rsi_14, atr_14, psar: recursions, one group a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        c, h, l = (pdf[x].astype(float) for x in ("close", "high", "low"))
        ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
        wilder = lambda s, n: s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        d = c.diff()
        up, down = wilder(d.clip(lower=0), 14), wilder(-d.clip(upper=0), 14)
        tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
        macd = ema(c, 12) - ema(c, 26)
        signal = ema(macd, 9)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = 100 - 100 / (1 + up / down)
        return pdf.assign(ema_20=ema(c, 20), macd=macd, macd_signal=signal, macd_hist=macd - signal, rsi_14=rsi, atr_14=wilder(tr, 14), psar=_psar(h.to_numpy(), l.to_numpy()))

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.groupBy(by).applyInPandas(run, fields + "".join(f", {x} double" for x in ("ema_20", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "psar")))


def all_indicators(df: DataFrame, by: str = "ticker", order: str = "date") -> DataFrame:
    """Every indicator. The recursions come first, so that the windows run on their output's partitioning."""
    return window_indicators(recursive_indicators(df, by, order), by, order)
