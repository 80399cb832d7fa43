"""Read-side queries over the tables of the data model; each takes frames and returns a frame."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio, sum_at_least
from tidemark.functions.text import plain
from tidemark.operators.aggregate import pair_stats, transpose
from tidemark.operators.joins import asof_join
from tidemark.operators.windows import latest


def companies(info: DataFrame) -> DataFrame:
    return info.where(F.coalesce("status", F.lit("active")) == "active").orderBy("company_name")


def hq_points(info: DataFrame, caps: DataFrame) -> DataFrame:
    """Companies with coordinates and their latest market cap."""
    last = caps.groupBy("corporate_id").agg(F.max_by("market_cap_usd", "date").alias("market_cap_usd"))
    return info.where("hq_lat IS NOT NULL AND hq_lon IS NOT NULL").join(last, "corporate_id", "left")


def hq_filter(points: DataFrame, cond: dict[str, list] | None = None, low: float | None = None, high: float | None = None, text: str | None = None) -> DataFrame:
    out = points
    for c, values in (cond or {}).items():
        if values:
            out = out.where(F.col(c).isin(*values))
    if low is not None:
        out = out.where(F.col("market_cap_usd") >= low)
    if high is not None:
        out = out.where(F.col("market_cap_usd") <= high)
    return out.where(F.lower("company_name").contains(text.lower())) if text else out


def search(info: DataFrame, text: str, limit: int = 8, name: str = "company_name", ticker: str = "primary_ticker") -> DataFrame:
    """Ranked: the ticker itself, tickers that begin so, names that begin so, a word that begins so, names that hold it."""
    q = info.sparkSession.createDataFrame([(text,)], "q string").select(plain("q").alias("__q"))
    d = info.crossJoin(F.broadcast(q)).withColumn("__n", plain(name)).withColumn("__t", F.lower(ticker))
    tier = F.when(F.col("__t") == F.col("__q"), 0).when(F.startswith("__t", "__q"), 1).when(F.startswith("__n", "__q"), 2).when(F.contains(F.concat(F.lit(" "), "__n"), F.concat(F.lit(" "), "__q")), 3).when(F.contains("__n", "__q"), 4)
    return d.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.length(name), name).limit(limit).drop("__q", "__n", "__t")


def header(prices: DataFrame, caps: DataFrame, by: str = "ticker") -> DataFrame:
    """(by, close, previous close, change, 52-week range, market cap) on each one's last day."""
    p = prices.where(~F.coalesce("price_suspect", F.lit(False))) if "price_suspect" in prices.columns else prices
    w = Window.partitionBy(by)
    p = p.withColumn("__last", F.max("date").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(F.desc("date"))))
    g = p.groupBy(by).agg(F.max(F.when(F.col("__rn") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("__rn") == 2, F.col("close"))).alias("prev_close"), F.max("date").alias("date"),
                          F.max(F.when(F.datediff("__last", "date") < 365, F.col("close"))).alias("high_52w"), F.min(F.when(F.datediff("__last", "date") < 365, F.col("close"))).alias("low_52w"))
    cap = caps.groupBy(by).agg(F.max_by("market_cap", "date").alias("market_cap"))
    return g.withColumn("change", ratio("close", "prev_close") - 1).join(cap, by, "left")


def daily_prices(prices: DataFrame, caps: DataFrame) -> DataFrame:
    return prices.where(~F.coalesce("price_suspect", F.lit(False))).join(caps.select("ticker", "date", "market_cap"), ["ticker", "date"], "left")


def last_days(df: DataFrame, day: str, n: int, by: list[str] | None = None) -> DataFrame:
    """Rows within n days of the last day (of each key)."""
    if by:
        return df.withColumn("__m", F.max(day).over(Window.partitionBy(*by))).where(F.datediff("__m", day) < n).drop("__m")
    top = df.agg(F.max(day).alias("__m"))
    return df.crossJoin(F.broadcast(top)).where(F.datediff("__m", day) < n).drop("__m")


def intraday_prices(bars: DataFrame, days: int) -> DataFrame:
    from tidemark.domain.intraday import new_york

    local = bars.withColumn("local", new_york("ts"))
    return last_days(local.withColumn("__d", F.to_date("local")), "__d", days, ["ticker"]).drop("__d")


def key_figures(quarters: DataFrame, flows: list[str], by: str = "corporate_id") -> DataFrame:
    """(by, item, ttm): sums of the last four quarters, null unless all four are there."""
    q = latest(quarters, by, [F.desc("fiscal_year"), F.desc("fiscal_quarter")], 4)
    return q.groupBy(by).agg(*[sum_at_least(c, 4).alias(c) for c in flows]).unpivot([by], flows, "item", "ttm")


def newest(df: DataFrame, by: list[str], order: str, n: int, cond: Column | None = None) -> DataFrame:
    """The newest n rows of each key: filings of some forms, annual reports, insider transactions, statements."""
    return latest(df.where(cond) if cond is not None else df, by, [F.desc_nulls_last(order)], n)


def statement(rows: DataFrame, items: list[str], period: str, periods: list) -> DataFrame:
    return transpose(rows, period, items, periods)


def not_empty(df: DataFrame, c: str, order: list) -> DataFrame:
    """Rows whose list has entries: holders, executives, subsidiaries."""
    return df.where(F.size(F.coalesce(c, F.array())) > 0).orderBy(*order)


def year_changes(rows: DataFrame, by: str, year: str, items: str) -> DataFrame:
    """Names added and removed against the year before; items is a list of structs with name."""
    names = F.transform(items, lambda s: s["name"])
    prev = F.lag("__n").over(Window.partitionBy(by).orderBy(year))
    out = rows.withColumn("__n", names).withColumn("__p", prev)
    return out.select(by, year, F.array_except("__n", "__p").alias("added"), F.array_except("__p", "__n").alias("removed"))


def earnings_history(earnings: DataFrame, prices: DataFrame, key: str = "ticker") -> DataFrame:
    """earnings (key, day, time) with the reaction: before the open the day's move, else the next day's, from the trading day on
    or before the date."""
    w = Window.partitionBy(key).orderBy("date")
    p = prices.select(key, F.col("date").alias("trade_date"), "close", F.lag("close").over(w).alias("prev"), F.lead("close").over(w).alias("next"))
    j = asof_join(earnings, p, "day", "trade_date", key)
    return j.withColumn("reaction", F.when(F.col("time") == "bmo", ratio("close", "prev") - 1).otherwise(ratio("next", "close") - 1))


def trials(sponsored: DataFrame) -> DataFrame:
    """One row a company and trial, the lead role before others."""
    return latest(sponsored, ["corporate_id", "nct_id"], [F.desc("is_lead"), "sponsor_name"])


def market_table(prices: DataFrame, instruments: DataFrame, units: DataFrame) -> DataFrame:
    """The long price table in major units, without helpers, removed instruments, copies and suspect days."""
    false = F.lit(False)
    i = instruments.where(~F.coalesce("is_helper", false) & (F.coalesce("status", F.lit("active")) != "removed") & ~F.endswith("ticker", F.lit("_FRED")))
    p = prices.where(~F.coalesce("price_suspect", false)).join(F.broadcast(i.select("ticker", "name", "asset_class", "group_name")), "ticker")
    return p.join(F.broadcast(units), p["currency"] == units["quoted"], "left").select("ticker", "name", "asset_class", "group_name", "date", (F.col("close") / F.coalesce("divisor", F.lit(1.0))).alias("close"), F.coalesce("major", F.upper("currency")).alias("currency"))


def last_runs(log: DataFrame) -> DataFrame:
    return latest(log, "step", [F.desc("started_at")])


def snapshot(prices: DataFrame, by: str = "ticker", yields: Column | None = None) -> DataFrame:
    """(by, last, d1, w1, m1, ytd, y1): change of the last value against the value on or before each reference day.

    Yields change in basis points. One aggregate: every reference is the last close up to its day.
    """
    p = prices.where("close IS NOT NULL").withColumn("__last", F.max("date").over(Window.partitionBy(by)))
    refs = {"d1": F.date_sub("__last", 1), "w1": F.date_sub("__last", 7), "m1": F.add_months("__last", -1), "ytd": F.date_sub(F.trunc("__last", "year"), 1), "y1": F.add_months("__last", -12)}
    g = p.groupBy(by).agg(F.max_by("close", "date").alias("last"), F.max("date").alias("date"), *[F.max_by("close", F.when(F.col("date") <= ref, F.col("date"))).alias(f"__{k}") for k, ref in refs.items()])
    is_yield = yields if yields is not None else F.lit(False)
    return g.select(by, "date", "last", *[F.when(is_yield, (F.col("last") - F.col(f"__{k}")) * 100).otherwise(ratio("last", f"__{k}") - 1).alias(k) for k in refs])


def rebase(prices: DataFrame, by: str = "ticker") -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return prices.withColumn("rebased", 100 * ratio("close", F.first("close", ignorenulls=True).over(w)))


def movers(snap: DataFrame, c: str = "d1", n: int = 8) -> DataFrame:
    up = snap.where(F.col(c).isNotNull()).orderBy(F.desc(c)).limit(n).withColumn("side", F.lit("up"))
    return up.unionByName(snap.where(F.col(c).isNotNull()).orderBy(F.asc(c)).limit(n).withColumn("side", F.lit("down")))


def change_correlation(prices: DataFrame, by: str = "ticker", limit: int = 5) -> DataFrame:
    """Correlations of daily changes; closes are carried over gaps of at most `limit` calendar days of the panel."""
    from tidemark.features import on_calendar
    from tidemark.operators.windows import ffill

    p = on_calendar(prices.withColumnRenamed(by, "ticker")).withColumn("close", ffill("close", "ticker", "date", limit))
    r = p.withColumn("r", ratio("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).where("r IS NOT NULL")
    return pair_stats(r, "ticker", "date", "r")


def class_counts(market: DataFrame) -> DataFrame:
    return market.groupBy("asset_class").agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("instruments"), F.max("date").alias("latest"))


def group_rollup(holders: DataFrame, by: list[str]) -> DataFrame:
    """Holders summed by their group, others by themselves; a sum is null only if all parts are."""
    return holders.groupBy(*by, F.coalesce("holder_group", "holder_name").alias("holder")).agg(F.sum("shares").alias("shares"), F.sum("pct_of_shares_out").alias("pct"), F.sum("change").alias("change"))


def yearly_counts(studies: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct studies by start year over a spine of years, zero where there is none."""
    spine = studies.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    n = studies.groupBy(F.year("start_date").alias("year")).agg(F.countDistinct("nct_id").alias("n"))
    return spine.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def quality_report(prices: DataFrame) -> DataFrame:
    """(ticker, rows, missing, bad_ohlc, extreme, stale, longest_gap): checks of a price table."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = F.abs(ratio("close", F.lag("close").over(w)) - 1)
    x = prices.withColumn("__r", r).withColumn("__gap", F.datediff("date", F.lag("date").over(w)))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return x.groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if(F.col("close").isNull()).alias("missing"), F.count_if(bad).alias("bad_ohlc"), F.count_if(F.col("__r") > 0.5).alias("extreme"), F.count_if(F.col("__r") == 0).alias("stale"), F.max("__gap").alias("longest_gap"))


#: Forms that the overview lists.
FORMS = ("10-K", "10-Q", "8-K", "20-F", "10-K/A", "10-Q/A", "DEF 14A")


def fiscal_label(year, quarter=None) -> Column:
    """FY2020, or Q3 2020."""
    y = F.col(year).cast("string")
    return F.concat(F.lit("FY"), y) if quarter is None else F.concat(F.lit("Q"), F.col(quarter).cast("string"), F.lit(" "), y)


def selected(df: DataFrame, tickers: list[str] | None, c: str = "ticker") -> DataFrame:
    """Rows of the tickers asked for; all of them without a list."""
    return df.where(F.col(c).isin(*tickers)) if tickers else df


def has_intraday(tickers: DataFrame, bars: DataFrame, by: str = "ticker") -> DataFrame:
    """tickers with has_intraday: whether any bar is there."""
    there = bars.select(by).distinct().withColumn("has_intraday", F.lit(True))
    return tickers.join(there, by, "left").withColumn("has_intraday", F.coalesce("has_intraday", F.lit(False)))


def filings(rows: DataFrame, n: int = 8, by: str = "corporate_id", forms=FORMS) -> DataFrame:
    """The newest n filings of the listed forms for each company, the later accession first on one day."""
    return latest(rows.where(F.col("form_type").isin(*forms)), by, [F.desc("filed_date"), F.desc("accession_no")], n)


def filing_path(cik: str, accession: str, doc: str) -> Column:
    """Path of a filing's main document in the public archive: filer, accession without dashes, file."""
    return F.concat_ws("/", F.col(cik).cast("long").cast("string"), F.replace(F.col(accession).cast("string"), F.lit("-"), F.lit("")), F.col(doc))


def financials(rows: DataFrame, n: int = 10, quarterly: bool = False, by: str = "corporate_id") -> DataFrame:
    """The newest n fiscal years, or quarters by their end, that have a period end, with label."""
    order = [F.desc("period_end")] if quarterly else [F.desc("fiscal_year")]
    label = fiscal_label("fiscal_year", "fiscal_quarter" if quarterly else None)
    return latest(rows.where("period_end IS NOT NULL"), by, order, n).withColumn("label", label)


def holder_quarters(rows: DataFrame) -> DataFrame:
    """Quarters with holders or a share held by institutions, with label."""
    return rows.where("top_holders IS NOT NULL OR inst_ownership_pct IS NOT NULL").withColumn("label", fiscal_label("fiscal_year", "fiscal_quarter"))


def insider_transactions(rows: DataFrame, n: int = 50, by: str = "corporate_id", tie: str = "accession_no") -> DataFrame:
    """The newest n transactions of each company with their value; a missing suspicion is none."""
    x = latest(rows, by, [F.desc("filing_date"), F.desc("trans_date"), F.desc(tie)], n)
    return x.withColumn("value", F.col("shares") * F.col("price")).withColumn("date_suspect", F.coalesce("date_suspect", F.lit(False)))


def annual_reports(rows: DataFrame, n: int = 6, by: str = "corporate_id") -> DataFrame:
    """The newest n fiscal years with a report's date."""
    return latest(rows.where("annual_report_date IS NOT NULL"), by, [F.desc("fiscal_year")], n)


def dividends_splits(prices: DataFrame, actions: DataFrame, n: int = 12, by: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """The newest n dividends of each ticker, and all its corporate actions, newest first."""
    return latest(prices.where("dividends > 0"), by, [F.desc("date")], n), actions.orderBy(by, F.desc("date"))


def trial_versions(raw: DataFrame, by: str = "nct_id") -> DataFrame:
    """raw versions with age, 1 for the newest, and the days since the version before."""
    w = Window.partitionBy(by).orderBy(F.desc("version"))
    return raw.withColumn("age", F.row_number().over(w)).withColumn("days_since", F.datediff("downloaded_at", F.lead("downloaded_at").over(w)))
