"""Fifty-four cross-sectional features of price panels, ranked across names on each as-of date.

Rows of a name carry what windows along its history give (returns, rolling deviations); each as-of date then takes its
trailing rows of the shared calendar, numbered backwards from it, and one aggregate a (date, name) gives all features.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import finite, kurt_sample, ratio, skew_sample, unit_rank

YEAR, SKIP, LEAST_ROWS, LEAST_NAMES = 252, 21, 300, 2
ANN = math.sqrt(YEAR)
ALPHA = 1 / 14

GROUPS = {
    "momentum": ("mom_1w", "mom_2w", "mom_1m", "mom_3m", "mom_6m", "mom_9m", "mom_12_1", "mom_12_1_lag", "mom_chg_12_1", "mom_accel_3m", "dist_52w_high", "dist_52w_low",
                 "ma_ratio_50_200", "ma_ratio_20_100", "px_vs_200dma", "trend_tstat_6m", "trend_r2_6m", "info_discreteness"),
    "reversal": ("bb_position", "ma50_zscore", "rsi_14", "overnight_ret_3m", "intraday_ret_3m", "overnight_share"),
    "volatility": ("vol_1m", "vol_3m", "vol_6m", "vol_12m", "vol_ratio", "parkinson_1m", "parkinson_3m", "garman_klass_1m", "downside_vol_6m", "ret_skew_6m", "ret_kurt_6m", "max_ret_1m", "min_ret_1m", "vol_of_vol_6m"),
    "market_risk": ("beta_12m", "downside_beta_12m", "idio_vol_12m", "resid_mom_12_1", "avg_corr_60d"),
    "liquidity": ("amihud_1m", "amihud_6m", "dollar_vol_level", "dollar_vol_trend", "volume_shock", "pv_corr_1m"),
    "tail": ("var_95_12m", "cvar_95_12m", "max_dd_12m", "ulcer_12m", "days_since_high"),
}
FEATURES = [f for g in GROUPS.values() for f in g]


def adjusted(prices: DataFrame) -> DataFrame:
    """Open, high and low scaled by adj_close / close, close adjusted; non-positive prices are missing. raw is the quoted close."""
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    k = ratio(good("adj_close"), good("close"))
    return prices.select("ticker", "date", (good("open") * k).alias("open"), (good("high") * k).alias("high"), (good("low") * k).alias("low"), good("adj_close").alias("close"), good("close").alias("raw"), F.col("volume").cast("double").alias("volume"))


def history(panel: DataFrame) -> DataFrame:
    """panel (ticker, date, open, high, low, close, raw, volume) with what each row takes from the rows before it.

    The rows of a name are those of the shared calendar; days without a price are nulls.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    c, o = F.col("close"), F.col("open")
    x = panel.withColumn("prev", F.lag("close").over(w)).withColumn("ret", ratio(c, F.col("prev")) - 1).withColumn("logret", F.ln(ratio(c, F.col("prev"))))
    x = x.withColumn("overnight", ratio(o, F.col("prev")) - 1).withColumn("intraday", ratio(c, o) - 1).withColumn("hl", F.ln(ratio("high", "low"))).withColumn("co", F.ln(ratio(c, o)))
    x = x.withColumn("dollar", F.nullif(F.col("raw") * F.col("volume"), F.lit(0.0))).withColumn("dvol", ratio("volume", F.lag("volume").over(w)) - 1)
    last21 = w.rowsBetween(-20, 0)
    return x.withColumn("std21", F.when(F.count("ret").over(last21) >= 21, F.stddev_samp("ret").over(last21)))


def on_calendar(panel: DataFrame) -> DataFrame:
    """Every name on every date of the panel between its own first and last date."""
    span = panel.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = panel.select("date").distinct()
    grid = span.join(days, (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("b"))).select("ticker", "date")
    return grid.join(panel, ["ticker", "date"], "left")


def trailing(rows: DataFrame, asofs: DataFrame, n: int = LEAST_ROWS) -> DataFrame:
    """(asof, k, ...): for each as-of date the last n calendar rows, k counting back from 0.

    Each row of the calendar is in at most as many trailing windows as there are as-of dates, a short list.
    """
    cal = rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    at = asofs.join(cal, F.col("date") <= F.col("asof")).groupBy("asof").agg(F.max("i").alias("top"))
    used = at.select("asof", "top", F.explode(F.sequence(F.greatest(F.col("top") - (n - 1), F.lit(1)), F.col("top"))).alias("i"))
    used = used.join(cal, "i").select("asof", (F.col("top") - F.col("i")).alias("k"), "date")
    return rows.join(F.broadcast(used), "date")


def _features() -> dict[str, Column]:
    k = F.col("k")
    last = lambda n, c, fn=F.avg, skip=0: fn(F.when((k < n) & (k >= skip), F.col(c)))
    at = lambda n, c="close": F.max(F.when(k == n, F.col(c)))
    out: dict[str, Column] = {f"mom_{s}": ratio(at(0), at(n)) - 1 for s, n in (("1w", 5), ("2w", 10), ("1m", 21), ("3m", 63), ("6m", 126), ("9m", 189))}
    out["mom_12_1"] = ratio(at(SKIP), at(YEAR)) - 1
    out["mom_12_1_lag"] = ratio(at(42), at(273)) - 1
    out["mom_chg_12_1"] = out["mom_12_1"] - out["mom_12_1_lag"]
    zero = F.lit(0.0)
    out["mom_accel_3m"] = F.coalesce(last(63, "ret", F.sum), zero) - F.coalesce(last(126, "ret", F.sum, 63), zero)
    out["dist_52w_high"] = ratio(at(0), last(YEAR, "close", F.max)) - 1
    out["dist_52w_low"] = ratio(at(0), last(YEAR, "close", F.min)) - 1
    out["ma_ratio_50_200"] = ratio(last(50, "close"), last(200, "close")) - 1
    out["ma_ratio_20_100"] = ratio(last(20, "close"), last(100, "close")) - 1
    out["px_vs_200dma"] = ratio(at(0), last(200, "close")) - 1
    y, x = F.when(k < 126, F.ln("close")), F.when(k < 126, -k.cast("double"))
    n, r2, slope = F.count(y), F.regr_r2(y, x), F.regr_slope(y, x)
    out["trend_r2_6m"] = r2
    out["trend_tstat_6m"] = F.signum(slope) * F.sqrt(ratio(r2 * (n - 2), 1 - r2))
    window = (k >= SKIP) & (k < YEAR)
    pos, neg = F.count_if(window & (F.col("ret") > 0)), F.count_if(window & (F.col("ret") < 0))
    out["info_discreteness"] = F.signum(out["mom_12_1"]) * ratio(neg - pos, pos + neg)
    out["bb_position"] = ratio(at(0) - last(20, "close"), 2 * last(20, "close", F.stddev_samp))
    out["ma50_zscore"] = ratio(at(0) - last(50, "close"), last(50, "close", F.stddev_samp))
    # the recursion over exactly a year of returns, written out: the weight of a row depends on its age alone
    age = F.when(k < YEAR - 1, ALPHA * F.pow(F.lit(1 - ALPHA), k)).otherwise(F.pow(F.lit(1 - ALPHA), F.lit(YEAR - 1)))
    gain = F.sum(F.when(k < YEAR, age * F.greatest(F.col("ret"), zero)))
    loss = F.sum(F.when(k < YEAR, age * F.greatest(-F.col("ret"), zero)))
    out["rsi_14"] = F.when(loss > 0, 100 - 100 / (1 + gain / F.nullif(loss, zero))).when(gain > 0, 100.0)
    on, intra = last(63, "overnight", F.sum), last(63, "intraday", F.sum)
    out |= {"overnight_ret_3m": on, "intraday_ret_3m": intra, "overnight_share": ratio(on, F.abs(on) + F.abs(intra))}
    out |= {f"vol_{s}": last(m, "ret", F.stddev_samp) * ANN for s, m in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", YEAR))}
    out["vol_ratio"] = ratio(last(21, "ret", F.stddev_samp), last(YEAR, "ret", F.stddev_samp))
    hl2 = F.col("hl") * F.col("hl")
    for s, m in (("1m", 21), ("3m", 63)):
        out[f"parkinson_{s}"] = F.sqrt(F.avg(F.when(k < m, hl2)) / (4 * math.log(2))) * ANN
    gk = 0.5 * hl2 - (2 * math.log(2) - 1) * F.col("co") * F.col("co")
    out["garman_klass_1m"] = F.sqrt(F.greatest(F.avg(F.when(k < 21, gk)), zero)) * ANN
    out["downside_vol_6m"] = F.sqrt(F.avg(F.when(k < 126, F.pow(F.least(F.col("ret"), zero), 2)))) * ANN
    out["ret_skew_6m"], out["ret_kurt_6m"] = skew_sample(F.when(k < 126, F.col("ret"))), kurt_sample(F.when(k < 126, F.col("ret")))
    out["max_ret_1m"], out["min_ret_1m"] = last(21, "ret", F.max), last(21, "ret", F.min)
    out["vol_of_vol_6m"] = last(126, "std21", F.stddev_samp)
    both = F.col("logret").isNotNull() & F.col("mkt").isNotNull()
    y = lambda cond: F.when(cond & both, F.col("logret"))
    m = lambda cond: F.when(cond & both, F.col("mkt"))
    year, down, former = k < YEAR, (k < YEAR) & (F.col("mkt") < 0), (k < YEAR) & (k >= SKIP)
    beta = lambda c: ratio(F.covar_pop(y(c), m(c)), F.var_pop(m(c)))
    out["beta_12m"], out["downside_beta_12m"] = beta(year), beta(down)
    out["idio_vol_12m"] = F.sqrt(F.greatest(F.var_pop(y(year)) - beta(year) * F.covar_pop(y(year), m(year)), zero)) * ANN
    b = beta(former)
    var_e = F.var_samp(y(former)) + b * b * F.var_samp(m(former)) - 2 * b * F.covar_samp(y(former), m(former))
    out["resid_mom_12_1"] = ratio(F.sum(y(former)) - b * F.sum(m(former)), F.sqrt(F.greatest(var_e, zero)) * F.sqrt(F.count(y(former)).cast("double")))
    for s, n_rows in (("1m", 21), ("6m", 126)):
        out[f"amihud_{s}"] = F.avg(F.when(k < n_rows, F.try_divide(F.abs("ret"), F.col("dollar"))))
    out["dollar_vol_level"] = F.ln(last(21, "dollar"))
    out["dollar_vol_trend"] = ratio(last(21, "dollar"), last(126, "dollar"))
    out["volume_shock"] = ratio(last(5, "volume"), last(60, "volume"))
    out["pv_corr_1m"] = F.corr(F.when(k < 21, F.col("ret")), F.when(k < 21, F.col("dvol")))
    out["var_95_12m"] = F.percentile(F.when(k < YEAR, F.col("ret")), F.lit(0.05))
    # drawdowns need the window's rows in order: one short array a (date, name)
    rows = F.sort_array(F.collect_list(F.when((k < YEAR) & F.col("close").isNotNull(), F.struct((-k).alias("o"), F.col("close").alias("c")))))
    start = F.struct(zero.alias("peak"), zero.alias("worst"), zero.alias("ss"), F.lit(0).alias("n"), zero.alias("at"))

    def step(s, v):
        peak = F.greatest(s["peak"], v["c"])
        dd = v["c"] / peak - 1
        return F.struct(peak.alias("peak"), F.least(s["worst"], dd).alias("worst"), (s["ss"] + dd * dd).alias("ss"), (s["n"] + 1).alias("n"), F.when(v["c"] > s["peak"], v["o"].cast("double")).otherwise(s["at"]).alias("at"))

    out["__dd"] = F.aggregate(rows, start, step)
    return out


def features(panel: DataFrame, asofs: DataFrame, universe: DataFrame | None = None, coverage: float = 0.9) -> DataFrame:
    """(asof, ticker, 54 features) before ranking.

    panel: ticker, date, open, high, low, close, raw, volume on the shared calendar (see on_calendar). asofs: asof. universe:
    asof, ticker pairs to keep. Names with less than `coverage` of the last year's closes are left out, and dates with fewer
    than 300 rows or two names.
    """
    rows = history(panel)
    mkt = rows.groupBy("date").agg(F.avg("logret").alias("mkt"))
    t = trailing(rows, asofs).join(mkt, "date")
    if universe is not None:
        t = t.join(F.broadcast(universe), ["asof", "ticker"])
    f = _features()
    enough = F.count_if((F.col("k") < YEAR) & F.col("close").isNotNull()) >= coverage * YEAR
    g = t.groupBy("asof", "ticker").agg(*[c.alias(n) for n, c in f.items()], enough.alias("__ok"), F.max("k").alias("__rows"))
    g = g.where(F.col("__ok"))
    var = g.select("asof", "ticker", F.col("var_95_12m").alias("__v"))
    cvar = t.where(F.col("k") < YEAR).join(var, ["asof", "ticker"]).groupBy("asof", "ticker").agg(F.avg(F.when(F.col("ret") <= F.col("__v"), F.col("ret"))).alias("cvar_95_12m"))
    recent = t.where((F.col("k") < 60) & F.col("ret").isNotNull()).select("asof", "date", "ticker", "ret").join(g.select("asof", "ticker"), ["asof", "ticker"], "left_semi")
    other = recent.select("asof", "date", F.col("ticker").alias("__b"), F.col("ret").alias("__r"))
    pair = recent.join(other, ["asof", "date"]).where("ticker <> __b").groupBy("asof", "ticker", "__b").agg(F.corr("ret", "__r").alias("c"))
    corr = pair.groupBy("asof", "ticker").agg(F.avg("c").alias("avg_corr_60d"))
    out = g.join(cvar, ["asof", "ticker"], "left").join(corr, ["asof", "ticker"], "left")
    out = out.withColumn("max_dd_12m", F.col("__dd.worst")).withColumn("ulcer_12m", F.sqrt(F.try_divide(F.col("__dd.ss"), F.col("__dd.n").cast("double")))).withColumn("days_since_high", -F.col("__dd.at"))
    size = Window.partitionBy("asof")
    out = out.withColumn("__names", F.count("*").over(size)).withColumn("__rows", F.max("__rows").over(size)).where((F.col("__names") >= LEAST_NAMES) & (F.col("__rows") >= LEAST_ROWS - 1))
    return out.select("asof", "ticker", *[finite(F.col(n).cast("double")).alias(n) for n in FEATURES])


def ranked(f: DataFrame) -> DataFrame:
    """Each feature as its mean rank among the names of the date, scaled to [0, 1]; 0.5 where it is missing."""
    return f.select("asof", "ticker", *[unit_rank(c, "asof").alias(c) for c in f.columns if c not in ("asof", "ticker")])


def feature_panel(prices: DataFrame, asofs: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    return ranked(features(on_calendar(adjusted(prices)), asofs, universe))


def forward_returns(panel: DataFrame, days: int) -> DataFrame:
    """(ticker, date, fwd): return over the next `days` rows of the calendar, null at the end."""
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.select("ticker", "date", (ratio(F.lead("close", days).over(w), F.col("close")) - 1).alias("fwd"))


def rank_ic(f: DataFrame, by: str, signal: str, label: str) -> DataFrame:
    """(by, ic, n): correlation of the mean ranks of signal and label on each date."""
    from tidemark.functions.semantics import avg_rank

    both = f.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    r = both.withColumn("__a", avg_rank(signal, by)).withColumn("__b", avg_rank(label, by))
    return r.groupBy(by).agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n"))
