"""Rule-based regimes: signals, score, smoothing on observations, hysteresis, confirmation.

Input is long (market, date, ticker, close); a market's named tickers become columns, a handful, and every series of a market
is one partition. Confirmation is causal by default: an unconfirmed day keeps the last confirmed label. look_ahead=True gives
unconfirmed stretches the next confirmed label instead, as the published rules do.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio, row_mean
from tidemark.operators.windows import fold

BY, DAY = "market", "date"


class Series:
    """A frame (market, date, columns) that grows by named columns."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._n = 0

    @classmethod
    def wide(cls, long: DataFrame, tickers: dict[str, str]) -> "Series":
        """tickers: ticker -> column name; absent tickers are null columns."""
        p = long.groupBy(BY, DAY).pivot("ticker", list(tickers)).agg(F.max("close"))
        return cls(p.select(BY, DAY, *[F.col(f"`{t}`").cast("double").alias(n) for t, n in tickers.items()]))

    def put(self, name: str, expr: Column) -> str:
        self.df = self.df.withColumn(name, expr)
        return name

    def _own(self, c: str) -> Window:
        """Rows where c is there: windows then count observations, not days."""
        return Window.partitionBy(BY, F.col(c).isNull()).orderBy(DAY)

    def smooth(self, c: str, n: int, least: int | None = None, fn=F.avg, out: str | None = None) -> str:
        w = self._own(c).rowsBetween(-(n - 1), 0)
        return self.put(out or f"{c}_m{n}", F.when(F.col(c).isNotNull() & (F.count(c).over(w) >= (max(1, n // 2) if least is None else least)), fn(c).over(w)))

    def change(self, c: str, n: int, relative: bool = True, out: str | None = None) -> str:
        back = F.lag(c, n).over(self._own(c))
        return self.put(out or f"{c}_d{n}", F.when(F.col(c).isNotNull(), ratio(c, back) - 1 if relative else F.col(c) - back))

    def flag(self, cond: Column, out: str) -> str:
        """1 or 0; an unknown comparison is 0."""
        return self.put(out, F.coalesce(cond.cast("double"), F.lit(0.0)))

    def score(self, weights: dict[str, float], out: str = "score") -> str:
        total = F.lit(0.0)
        for c, k in weights.items():
            total = total + F.coalesce(F.col(c), F.lit(0.0)) * k
        return self.put(out, total)

    def hysteresis(self, c: str, bull: float, bear: float, bull_exit: float | None = None, bear_exit: float | None = None, through_neutral: bool = False, out: str = "raw") -> str:
        """2 bull, 1 neutral, 0 bear, null where c is; entry and exit levels make a dead band.

        through_neutral: bull and bear never follow each other directly.
        """
        be, re = F.lit(bull if bull_exit is None else bull_exit), F.lit(bear if bear_exit is None else bear_exit)

        def step(s: Column, v: Column) -> Column:
            fresh = F.when(v >= bull, 2).when(v <= bear, 0).otherwise(1)
            if through_neutral:
                from_bull, from_bear = F.when(v < be, 1).otherwise(2), F.when(v > re, 1).otherwise(0)
            else:
                from_bull = F.when(v <= bear, 0).when(v < be, 1).otherwise(2)
                from_bear = F.when(v >= bull, 2).when(v > re, 1).otherwise(0)
            new = F.when(s["state"] == 2, from_bull).when(s["state"] == 0, from_bear).otherwise(fresh)
            return F.struct(F.when(v.isNull(), s["state"]).otherwise(new).alias("state"), F.when(v.isNotNull(), new).alias("label"))

        none = F.lit(None).cast("int")
        states = fold(self.df.select(BY, DAY, c), BY, DAY, c, "__s", F.struct(none.alias("state"), none.alias("label")), step)
        self.df = self.df.join(states.select(BY, DAY, F.col("__s.label").alias(out)), [BY, DAY], "left")
        return out

    def confirm(self, c: str, n: int, agree: int, least: int | None = None, look_ahead: bool = False, out: str = "confirmed") -> str:
        """c where at least `agree` of the last n days hold it, else the last confirmed label."""
        w = Window.partitionBy(BY).orderBy(DAY)
        last = w.rowsBetween(-(n - 1), 0)
        same = F.size(F.filter(F.collect_list(c).over(last), lambda x: x == F.col(c)))
        self.put("__c", F.when((F.count(c).over(last) >= (n if least is None else least)) & (same >= agree), F.col(c)))
        if look_ahead:
            self.put("__c", F.coalesce(F.first("__c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
        else:
            self.put("__c", F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        self.put(out, F.col("__c"))
        self.df = self.df.drop("__c")
        return out

    def label(self, c: str, names: dict[int, str], out: str) -> str:
        e = F.lit("Unknown")
        for k, v in names.items():
            e = F.when(F.col(c) == k, F.lit(v)).otherwise(e)
        return self.put(out, e)


def three(bull: str, neutral: str, bear: str) -> dict[int, str]:
    return {2: bull, 1: neutral, 0: bear}


def breadth(prices: DataFrame, group: str = "continent", n: int = 200, least: int = 5) -> DataFrame:
    """(market, date, group, n_available, n_above, breadth): share of names above their own n-observation mean."""
    p = prices.where("close IS NOT NULL")
    w = Window.partitionBy(BY, "ticker").orderBy(DAY).rowsBetween(-(n - 1), 0)
    ma = F.when(F.count("close").over(w) >= n, F.avg("close").over(w))
    x = p.withColumn("__ma", ma)
    g = x.groupBy(BY, DAY, group).agg(F.count("__ma").alias("n_available"), F.count_if(F.col("close") > F.col("__ma")).alias("n_above"))
    return g.withColumn("breadth", F.when(F.col("n_available") >= least, F.col("n_above") / F.col("n_available")))


def equity_regime(prices: DataFrame, group: str = "continent", ma: int = 200, least: int = 5, smooth: int = 10, bull: float = 0.60, bear: float = 0.50, window: int = 7, agree: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per group and overall: breadth, smoothed, with hysteresis, confirmed by 5 of 7. Overall is bull or bear if all groups agree."""
    b = breadth(prices, group, ma, least).withColumn("__m", F.col(BY)).withColumn(BY, F.concat_ws("\x01", F.col(BY).cast("string"), group))
    s = Series(b)
    w = Window.partitionBy(BY).orderBy(DAY).rowsBetween(-3, 0)
    s.put("breadth", F.last("breadth", ignorenulls=True).over(w))
    s.smooth("breadth", smooth, out="breadth_smooth")
    s.hysteresis("breadth_smooth", bull, bear)
    kept = Series(s.df.where("breadth_smooth IS NOT NULL"))  # confirmation runs on the days that have a score
    kept.confirm("raw", window, agree)
    s.df = s.df.join(kept.df.select(BY, DAY, "confirmed"), [BY, DAY], "left")
    s.put("score", F.last("confirmed", ignorenulls=True).over(Window.partitionBy(BY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)) - 1)
    groups = s.df.select(F.col("__m").alias(BY), DAY, group, "n_available", "n_above", "breadth", "breadth_smooth", "score")
    g = groups.groupBy(BY, DAY).agg(F.bool_and(F.col("score") == 1).alias("up"), F.bool_and(F.col("score") == -1).alias("down"), F.count("score").alias("k"), F.avg("breadth_smooth").alias("mean_breadth"))
    total = F.when(F.col("k") == 0, "Unknown").when(F.col("up"), "Bull").when(F.col("down"), "Bear").otherwise("Neutral")
    return groups, g.select(BY, DAY, total.alias("global_regime"), "mean_breadth")


#: Tickers of the rules.
BONDS = {"^IRX": "irx", "^FVX": "fvx", "^TNX": "tnx", "^TYX": "tyx", "TIP": "tip", "IEF": "ief", "TLT": "tlt", "SHY": "shy"}
FOREX = {"DX-Y.NYB": "dxy", "AUDJPY=X": "audjpy", "NZDJPY=X": "nzdjpy", "USDJPY=X": "usdjpy", "EURCHF=X": "eurchf", "EURUSD=X": "eurusd"}
EMERGING = {"USDMXN=X": "mxn", "USDINR=X": "inr", "USDCNY=X": "cny", "USDZAR=X": "zar", "USDTRY=X": "try", "USDBRL=X": "brl", "USDKRW=X": "krw"}
COMMODITIES = {"CL=F": "wti", "BZ=F": "brent", "HG=F": "copper", "GC=F": "gold", "SI=F": "silver", "NG=F": "gas", "ZC=F": "corn", "ZW=F": "wheat", "ZS=F": "soy"}
CRYPTO = {"BTC-USD": "btc", "ETH-USD": "eth"}


def bond_regime(prices: DataFrame, look_ahead: bool = False) -> DataFrame:
    """Curve, rate momentum, real yields and long bonds: four signals, entered at 3 and 1, left at 2; 16 of 21 days confirm."""
    s = Series.wide(prices, BONDS)
    s.put("curve_2s10s", F.col("tnx") - F.col("irx"))
    s.put("curve_5s30s", F.col("tyx") - F.col("fvx"))
    s.smooth("curve_2s10s", 5, out="curve_2s10s_smooth")
    c = F.col("curve_2s10s_smooth")
    s.put("curve_regime", F.when(c > 1.0, "Steep").when(c > 0, "Normal").when(c > -0.5, "Flat").otherwise("Inverted"))
    s.smooth("tnx", 200, out="rate_ma200")
    s.smooth("tnx", 50, out="rate_ma50")
    s.change("tnx", 63, relative=False, out="rate_momentum")
    s.smooth("rate_momentum", 10, out="rate_momentum_smooth")
    m = F.col("rate_momentum_smooth")
    s.put("policy_direction", F.when(m > 0.5, "Tightening").when(m < -0.5, "Easing").otherwise("Neutral"))
    for x in ("tip", "ief"):
        s.smooth(x, 252, out=f"{x}_mean")
    s.put("real_yield_proxy", ratio(ratio("tip", "tip_mean"), ratio("ief", "ief_mean")))
    s.smooth("real_yield_proxy", 10, out="real_yield_smooth")
    y = F.col("real_yield_smooth")
    s.put("real_yield_regime", F.when(y > 1.02, "Falling Real").when(y < 0.98, "Rising Real").otherwise("Neutral"))
    s.smooth("tlt", 200, out="tlt_ma200")
    s.smooth("tlt", 5, out="tlt_smooth")
    for x in ("shy", "tlt"):
        s.smooth(x, 50, out=f"{x}_m50")
    s.put("duration_spread", ratio("shy", "shy_m50") - ratio("tlt", "tlt_m50"))
    s.flag(c > 0, "sig_curve_ok")
    s.flag(m < 0, "sig_yields_falling")
    s.flag(F.col("tlt_smooth") > F.col("tlt_ma200"), "sig_tlt_uptrend")
    s.flag(y > 1.02, "sig_real_falling")
    s.score({k: 1.0 for k in ("sig_curve_ok", "sig_yields_falling", "sig_tlt_uptrend", "sig_real_falling")})
    s.smooth("score", 20, out="score_smooth")
    s.hysteresis("score_smooth", 3.0, 1.0, 2.0, 2.0)
    s.confirm("raw", 21, 16, look_ahead=look_ahead)
    s.label("confirmed", three("Bond Bull", "Bond Neutral", "Bond Bear"), "bond_regime")
    return s.df


def _scored(s: Series, score: str, bull: float, bear: float, names: dict[int, str], out: str, look_ahead: bool) -> None:
    s.smooth(score, 15, out=f"{score}_smooth")
    s.hysteresis(f"{score}_smooth", bull, bear, out=f"{score}_raw")
    s.put(f"{score}_raw", F.coalesce(f"{score}_raw", F.lit(-1)))
    s.confirm(f"{score}_raw", 7, 5, least=5, look_ahead=look_ahead, out=f"{score}_confirmed")
    s.label(f"{score}_confirmed", names, out)


def currency_strength(prices: DataFrame, signs: DataFrame, days: int = 20) -> DataFrame:
    """(market, date, currency, strength): mean signed change over a currency's pairs. signs: currency, ticker, sign."""
    w = Window.partitionBy(BY, "ticker").orderBy(DAY)
    r = prices.withColumn("__r", ratio("close", F.lag("close", days).over(w)) - 1)
    return r.join(F.broadcast(signs), "ticker").groupBy(BY, DAY, "currency").agg(F.avg(F.col("__r") * F.col("sign")).alias("strength"))


def forex_regime(prices: DataFrame, eur_strength: DataFrame | None = None, look_ahead: bool = False, least_pairs: int = 10) -> DataFrame:
    """Dollar, carry, yen, Europe and emerging-market labels, and the master label from the dollar index and AUD/JPY."""
    s = Series.wide(prices, FOREX | EMERGING)
    n = prices.where("close IS NOT NULL").groupBy(BY, DAY).agg(F.countDistinct("ticker").alias("__pairs"))
    s.df = s.df.join(n, [BY, DAY], "left")
    for c, k in (("dxy", 5), ("audjpy", 10), ("nzdjpy", 10)):
        s.smooth(c, k, out=f"{c}_s")
    for c in ("dxy", "audjpy", "nzdjpy", "usdjpy", "eurchf", "eurusd"):
        s.smooth(c, 200, out=f"{c}_ma200")
    # dollar
    s.change("dxy", 63, out="dxy_momentum")
    s.smooth("dxy_momentum", 15, out="dxy_momentum_smooth")
    s.smooth("dxy", 126, 126, F.max, out="dxy_high")
    w = Window.partitionBy(BY).orderBy(DAY)
    s.flag(F.col("dxy_s") > F.col("dxy_ma200"), "sig_usd_level")
    s.flag(F.col("dxy_momentum_smooth") > 0, "sig_usd_momentum")
    s.flag(F.col("dxy_high") > F.lag("dxy_high", 21).over(w), "sig_usd_accel")
    s.score({"sig_usd_level": 1, "sig_usd_momentum": 1, "sig_usd_accel": 1}, "usd_score")
    _scored(s, "usd_score", 2.5, 0.5, three("USD Bull", "USD Neutral", "USD Bear"), "usd_regime", look_ahead)
    # carry: the level counts twice; without NZD/JPY the level of AUD/JPY stands in
    s.change("audjpy", 63, out="audjpy_momentum")
    s.smooth("audjpy_momentum", 15, out="audjpy_momentum_smooth")
    s.flag(F.col("audjpy_s") > F.col("audjpy_ma200"), "sig_carry_level")
    s.flag(F.col("audjpy_momentum_smooth") > 0, "sig_carry_momentum")
    any_nzd = F.max(F.col("nzdjpy").isNotNull()).over(Window.partitionBy(BY))
    s.flag(F.when(any_nzd, F.col("nzdjpy_s") > F.col("nzdjpy_ma200")).otherwise(F.col("sig_carry_level") == 1), "sig_carry_nzd")
    s.score({"sig_carry_level": 2, "sig_carry_momentum": 1, "sig_carry_nzd": 1}, "carry_score")
    _scored(s, "carry_score", 3.0, 1.0, three("Carry Bull", "Carry Neutral", "Carry Bear"), "carry_regime", look_ahead)
    # yen
    for c in ("usdjpy", "audjpy"):
        s.change(c, 21, out=f"{c}_d21")
        s.smooth(f"{c}_d21", 10, out=f"{c}_d21s")
    s.flag(F.col("usdjpy") < F.col("usdjpy_ma200"), "sig_jpy_level")
    s.flag(F.col("usdjpy_d21s") < 0, "sig_jpy_rising")
    s.flag(F.col("audjpy_d21s") < 0, "sig_carry_falling")
    s.score({"sig_jpy_level": 1, "sig_jpy_rising": 1, "sig_carry_falling": 1}, "jpy_score")
    _scored(s, "jpy_score", 2.5, 0.5, three("JPY Bull", "JPY Neutral", "JPY Bear"), "jpy_regime", look_ahead)
    # Europe
    s.flag(F.col("eurchf") > F.col("eurchf_ma200"), "sig_eurchf_ok")
    s.flag(F.col("eurusd") > F.col("eurusd_ma200"), "sig_eurusd_trend")
    parts = {"sig_eurchf_ok": 1.0, "sig_eurusd_trend": 1.0}
    if eur_strength is not None:
        s.df = s.df.join(eur_strength.select(BY, DAY, F.col("strength").alias("eur_strength")), [BY, DAY], "left")
        s.flag(F.col("eur_strength") > 0, "sig_eur_strong")
        parts["sig_eur_strong"] = 1.0
    s.score(parts, "europe_score")
    _scored(s, "europe_score", 2.5, 0.5, three("Europe Stable", "Europe Neutral", "Europe Stress"), "europe_regime", look_ahead)
    # emerging markets: the mean of the pairs' one-year z-scores
    for c in EMERGING.values():
        s.smooth(c, 252, out=f"{c}_m")
        s.smooth(c, 252, fn=F.stddev_samp, out=f"{c}_sd")
        s.put(f"{c}_z", ratio(F.col(c) - F.col(f"{c}_m"), f"{c}_sd"))
    s.put("em_stress", row_mean(*[f"{c}_z" for c in EMERGING.values()]))
    s.smooth("em_stress", 15, out="em_stress_smooth")
    s.put("em_regime", F.when(F.col("em_stress_smooth") > 1.0, "EM Stress").when(F.col("em_stress_smooth") < -0.5, "EM Relief").otherwise("EM Neutral"))
    # master: windows of days, as these two prices define the calendar
    day = lambda c, k, least: F.when(F.count(c).over(w.rowsBetween(-(k - 1), 0)) >= least, F.avg(c).over(w.rowsBetween(-(k - 1), 0)))
    for c in ("dxy", "audjpy"):
        s.put(f"{c}_d200", day(c, 200, 100))
        s.put(f"{c}_d20", day(c, 20, 10))
    f = lambda x: F.coalesce(x, F.lit(False))
    usd, on, off = f(F.col("dxy_d20") > F.col("dxy_d200") * 1.02), f(F.col("audjpy_d20") > F.col("audjpy_d200") * 1.01), f(F.col("audjpy_d20") < F.col("audjpy_d200") * 0.99)
    s.put("master_raw", F.when(F.coalesce("__pairs", F.lit(0)) < least_pairs, -1).when(on & ~usd, 2).when(usd & off, 0).otherwise(1))
    s.confirm("master_raw", 15, 11, least=11, look_ahead=look_ahead, out="master")
    s.label("master", three("Risk On", "Neutral", "Stress"), "forex_regime")
    keep = [BY, DAY, "usd_score", "usd_regime", "carry_score", "carry_regime", "jpy_score", "jpy_regime", "europe_score", "europe_regime", "em_stress", "em_stress_smooth", "em_regime", "forex_regime"]
    return s.df.select(*keep)


def commodity_regime(prices: DataFrame, look_ahead: bool = False) -> DataFrame:
    """Copper over gold, energy, gold and grains vote; 2.7 / 2.1 and 1.3 / 1.9 on the smoothed votes, 11 of 15 days confirm."""
    s = Series.wide(prices, COMMODITIES)
    s.put("wti", F.greatest(F.col("wti"), F.when(F.col("wti").isNotNull(), 1.0)))
    s.put("copper_gold", ratio("copper", "gold"))
    for c in ("copper_gold", "wti", "brent", "gold", "silver", "corn", "wheat", "soy"):
        s.smooth(c, 200, out=f"{c}_ma200")
        s.smooth(c, 20, out=f"{c}_s")
        up = F.col(f"{c}_s") > F.col(f"{c}_ma200")
        s.flag(up, f"{c}_up")
        s.put(f"{c}_sig", F.when(F.col(c).isNotNull(), F.col(f"{c}_up")))
    for c in ("wti", "gold"):
        s.change(c, 63)
        s.smooth(f"{c}_d63", 10, out=f"{c}_mom")
        s.flag(F.col(f"{c}_mom") > 0, f"{c}_rising")
    part = Window.partitionBy(BY)
    has = lambda c: F.max(F.col(c).isNotNull()).over(part)
    for lead, second in (("wti", "brent"), ("gold", "silver")):
        confirm = F.when(has(second), F.col(f"{second}_up")).otherwise(F.col(f"{lead}_up"))
        s.put(f"{lead}_score", F.when(F.col(lead).isNotNull(), F.col(f"{lead}_up") + F.col(f"{lead}_rising") + confirm))
        s.flag(F.col(f"{lead}_score") >= 2, f"vote_{lead}")
    s.put("ag_signal", row_mean("corn_sig", "wheat_sig", "soy_sig"))
    s.flag(F.col("ag_signal") > 0.5, "vote_ag")
    for c in ("wti", "copper", "gold", "corn", "wheat", "gas"):
        s.change(c, 63, out=f"{c}_q")
    s.put("broad", row_mean(*[f"{c}_q" for c in ("wti", "copper", "gold", "corn", "wheat", "gas")]))
    s.smooth("broad", 20, out="broad_trend")
    s.score({"copper_gold_up": 1, "vote_wti": 1, "vote_gold": 1, "vote_ag": 1})
    s.smooth("score", 20, out="score_smooth")
    s.hysteresis("score_smooth", 2.7, 1.3, 2.1, 1.9)
    s.confirm("raw", 15, 11, least=11, look_ahead=look_ahead)
    s.label("confirmed", three("Commodity Bull", "Commodity Neutral", "Commodity Bear"), "commodity_regime")
    return s.df.select(BY, DAY, F.col("copper_gold_s").alias("copper_gold_smooth"), "copper_gold_ma200", "wti_score", "gold_score", "ag_signal", "broad_trend", "score", "score_smooth", "commodity_regime")


def crypto_regime(prices: DataFrame, look_ahead: bool = False) -> DataFrame:
    """Trend and momentum of the first coin, trend of the second, and their ratio; never from bull to bear directly; 7 of 10 confirm."""
    s = Series.wide(prices, CRYPTO)
    for c in ("btc", "eth"):
        s.smooth(c, 200, out=f"{c}_ma200")
        s.smooth(c, 5, out=f"{c}_s")
        s.flag(F.col(f"{c}_s") > F.col(f"{c}_ma200"), f"sig_{c}_up")
    s.change("btc", 63)
    s.smooth("btc_d63", 10, out="btc_momentum")
    s.flag(F.col("btc_momentum") > 0, "sig_btc_momentum")
    s.put("eth_btc", ratio("eth", "btc"))
    s.smooth("eth_btc", 50, out="eth_btc_ma")
    s.flag(F.col("eth_btc") > F.col("eth_btc_ma"), "sig_eth_leading")
    s.score({"sig_btc_up": 1, "sig_btc_momentum": 1, "sig_eth_up": 1, "sig_eth_leading": 1})
    s.smooth("score", 10, out="score_smooth")
    s.hysteresis("score_smooth", 3.5, 1.5, 2.5, 2.5, through_neutral=True)
    s.confirm("raw", 10, 7, least=7, look_ahead=look_ahead)
    s.label("confirmed", three("Crypto Bull", "Crypto Neutral", "Crypto Bear"), "crypto_regime")
    return s.df


#: Weights of the growth signals.
GROWTH_WEIGHTS = {"sig_yield_curve": 2.0, "sig_copper_gold": 2.0, "sig_equity_breadth": 1.5, "sig_bond_supportive": 1.0, "sig_usd_benign": 1.0, "sig_em_ok": 0.5}


def growth_regime(equity: DataFrame, bond: DataFrame, commodity: DataFrame, forex: DataFrame, pmi: DataFrame | None = None, look_ahead: bool = False) -> DataFrame:
    """Quadrants of a weighted score: above or below 0.55, rising or falling over 21 observations. 15 of 21 days confirm.

    equity: market, date, mean_breadth. pmi: market, date, pmi (carried forward).
    """
    d = equity.select(BY, DAY, "mean_breadth").join(bond.select(BY, DAY, "curve_2s10s_smooth", "bond_regime"), [BY, DAY], "left")
    d = d.join(commodity.select(BY, DAY, "copper_gold_smooth", "copper_gold_ma200"), [BY, DAY], "left").join(forex.select(BY, DAY, "usd_regime", "em_stress_smooth"), [BY, DAY], "left")
    weights = dict(GROWTH_WEIGHTS)
    if pmi is not None:
        d = d.join(pmi.select(BY, DAY, "pmi"), [BY, DAY], "left")
        d = d.withColumn("pmi", F.last("pmi", ignorenulls=True).over(Window.partitionBy(BY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)))
    s = Series(d)
    s.flag(F.col("curve_2s10s_smooth") > 0, "sig_yield_curve")
    s.flag(ratio("copper_gold_smooth", "copper_gold_ma200") - 1 > 0, "sig_copper_gold")
    s.flag(F.col("mean_breadth") > 0.55, "sig_equity_breadth")
    s.flag(~F.col("bond_regime").eqNullSafe("Bond Bear"), "sig_bond_supportive")
    s.flag(~F.col("usd_regime").eqNullSafe("USD Bull"), "sig_usd_benign")
    s.flag(F.col("em_stress_smooth") < 0.5, "sig_em_ok")
    if pmi is not None:
        s.flag(F.col("pmi") > 50, "sig_pmi")
        weights["sig_pmi"] = 1.5
    s.score({k: v / sum(weights.values()) for k, v in weights.items()}, "growth_score_raw")
    s.smooth("growth_score_raw", 21, out="growth_score_smooth")
    s.change("growth_score_smooth", 21, relative=False, out="growth_score_delta")
    f = lambda c: F.coalesce(c, F.lit(False))
    above, up = f(F.col("growth_score_smooth") >= 0.55), f(F.col("growth_score_delta") >= 0)
    s.put("raw", F.when(above & up, 3).when(above, 2).when(up, 1).otherwise(0))
    s.confirm("raw", 21, 15, least=15, look_ahead=look_ahead)
    s.label("confirmed", {3: "Expansion", 2: "Slowdown", 1: "Recovery", 0: "Contraction"}, "growth_regime")
    r = F.col("growth_regime")
    s.put("growth_simple", F.when(r.isin("Expansion", "Recovery"), "Growth").when(r == "Contraction", "Contraction").otherwise("Transition"))
    return s.df.select(BY, DAY, "growth_score_raw", "growth_score_smooth", "growth_score_delta", "growth_regime", "growth_simple")
