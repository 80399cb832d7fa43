"""Market capitalisation on one split basis: corporate actions, share counts, daily values, checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.domain import fx
from tidemark.functions.semantics import col
from tidemark.operators.joins import asof_join
from tidemark.operators.windows import latest, suffix_product

RATIO_TOLERANCE = 0.03
MAX_COUNT_DAYS = 120
STALE_DAYS = 400
JUMP = 0.30
LEAST_SHARES = 1e4
FOREVER_AGO = "1900-01-01"


def clean_ratios() -> list[float]:
    """p:q with p and q up to 10, and n:1 and 1:n up to 50."""
    return sorted({p / q for p in range(1, 11) for q in range(1, 11)} | {float(n) for n in range(1, 51)} | {1 / n for n in range(1, 51)})


def clean_ratio(r, tolerance: float = RATIO_TOLERANCE) -> Column:
    """The nearest clean split ratio, null if none is near."""
    r = col(r).cast("double")
    off = F.transform(F.array(*[F.lit(x) for x in clean_ratios()]), lambda c: F.struct(F.abs(r / c - 1).alias("off"), c.alias("ratio")))
    best = F.array_min(off)
    return F.when((r > 0) & (best["off"] <= tolerance), best["ratio"])


def sec_counts(rows: DataFrame) -> DataFrame:
    """One share count a company and as-of date, with the date on whose split basis it stands and its source.

    rows: corporate_id, shares_as_of, shares_outstanding, period_end, filed_date. Counts as of a day after the period's end
    are cover-page counts, real on their day; others are restated up to the filing.
    """
    cover = F.bool_or(F.col("shares_as_of") > F.col("period_end"))
    filed = F.max_by("filed_date", F.struct("shares_outstanding", "filed_date"))
    g = rows.where("shares_as_of IS NOT NULL").groupBy("corporate_id", F.col("shares_as_of").alias("d")).agg(F.max("shares_outstanding").alias("shares"), cover.alias("cover"), filed.alias("filed"))
    return g.select("corporate_id", "d", "shares", F.when(F.col("cover"), F.col("d")).otherwise(F.coalesce("filed", "d")).alias("basis"), F.when(F.col("cover"), "sec_cover_page").otherwise("sec_balance_sheet").alias("src"))


def classify_events(events: DataFrame, sec: DataFrame, current: DataFrame, overrides: dict | None = None, max_days: int = MAX_COUNT_DAYS) -> DataFrame:
    """Tells splits from price-only adjustments by the share counts around them.

    events: ticker, date, corporate_id, yahoo_factor. sec: corporate_id, d, shares, basis. current: corporate_id, shares, d.
    The count before is the last one dated and based before the event, the count after the first one based on or after it.
    """
    spark = events.sparkSession
    good = sec.where(F.col("shares") >= LEAST_SHARES).withColumn("basis", F.coalesce("basis", "d"))
    # a count is wholly before an event once both its dates are: the later of them is what the event is compared with
    before = good.select("corporate_id", F.greatest("d", "basis").alias("known"), F.struct("d", "basis", "shares").alias("before"))
    before = latest(before, ["corporate_id", "known"], [F.col("before").desc()])
    running = before.withColumn("before", F.max("before").over(Window.partitionBy("corporate_id").orderBy("known").rowsBetween(Window.unboundedPreceding, 0)))
    after = good.select("corporate_id", F.col("basis").alias("based"), F.struct("d", "basis", "shares").alias("after"))
    after = latest(after, ["corporate_id", "based"], [F.col("after").asc()])
    ahead = after.withColumn("after", F.min("after").over(Window.partitionBy("corporate_id").orderBy(F.desc("based")).rowsBetween(Window.unboundedPreceding, 0)))
    e = asof_join(events, running, "date", "known", "corporate_id", strict=True)
    e = asof_join(e, ahead, "date", "based", "corporate_id", direction="forward")
    e = e.join(good.select("corporate_id").distinct().withColumn("has_sec", F.lit(True)), "corporate_id", "left")
    now = current.where("shares > 0").select("corporate_id", F.col("shares").alias("now_shares"), F.col("d").alias("now_date"))
    e = e.join(now, "corporate_id", "left")
    fixed = spark.createDataFrame([(t, d, float(f)) for (t, d), f in (overrides or {}).items()], "ticker string, o_date string, o_factor double")
    e = e.join(F.broadcast(fixed.withColumn("date", F.col("o_date").cast("date")).drop("o_date")), ["ticker", "date"], "left")
    use_now = F.col("after").isNull() & (F.col("now_date") >= F.col("date"))
    e = e.withColumn("by_now", F.coalesce(use_now, F.lit(False))).withColumn("after", F.when(F.col("by_now"), F.struct(F.col("now_date").alias("d"), F.col("now_date").alias("basis"), F.col("now_shares").cast("double").alias("shares"))).otherwise(F.struct(F.col("after.d").alias("d"), F.col("after.basis").alias("basis"), F.col("after.shares").cast("double").alias("shares"))))
    e = e.withColumn("ratio", F.try_divide(F.col("after.shares"), F.col("before.shares").cast("double"))).withColumn("clean", clean_ratio("ratio")).withColumn("clean_y", clean_ratio("yahoo_factor"))
    gap_before = F.datediff("date", F.greatest("before.d", "before.basis"))
    gap_after = F.datediff(F.least("after.d", "after.basis"), F.col("date"))
    far = F.coalesce((gap_before > max_days) | (gap_after > max_days), F.lit(False))
    over, no_sec, no_before, no_after = F.col("o_factor").isNotNull(), F.col("has_sec").isNull(), F.col("before").isNull(), F.col("after.shares").isNull()
    confirms = far & F.col("clean").isNotNull() & (F.col("clean") != 1.0) & (F.col("clean") == F.col("clean_y"))
    counted = F.when(F.col("by_now"), "yfinance_after").otherwise("sec_counts")
    method = F.when(over, "override").when(no_sec | no_before, "no_sec_data").when(no_after, "price_only_review").when(confirms, counted).when(far | F.col("clean").isNull(), "price_only_review").otherwise(counted)
    factor = F.when(over, F.col("o_factor")).when(no_sec | no_before, F.col("yahoo_factor")).when(method == "price_only_review", 1.0).otherwise(F.col("clean"))
    review = F.when(over | no_sec, False).when(no_before, F.col("clean_y").isNull()).otherwise(method == "price_only_review")
    note = (F.when(over, "override").when(no_sec, F.lit(None)).when(no_before & F.col("clean_y").isNull(), "before the first count: the quoted factor is used").when(no_before, "before the first count")
            .when(no_after, "no count after the event yet").when(confirms, "far counts confirm the ratio").when(far, "counts are far from the event").when(F.col("clean").isNull(), "no clean ratio of the counts"))
    out = e.withColumn("method", method).withColumn("split_factor", factor).withColumn("review", review).withColumn("note", note)
    shown = ~over & ~no_sec
    return out.select("ticker", "date", "corporate_id", "yahoo_factor", "split_factor", (F.col("yahoo_factor") / F.col("split_factor")).alias("price_only_factor"), "method",
                      F.when(shown, F.col("before.d")).alias("sec_before_date"), F.when(shown, F.col("before.shares")).alias("sec_before_shares"),
                      F.when(shown & ~no_before, F.col("after.d")).alias("sec_after_date"), F.when(shown & ~no_before, F.col("after.shares")).alias("sec_after_shares"), "note", "review")


def clean_sec_shares(ev: DataFrame) -> DataFrame:
    """Counts (corporate_id, d, shares_today) without placeholders, wrong scales, outliers among neighbours and single blips."""
    w = Window.partitionBy("corporate_id").orderBy("d")
    s = F.col("shares_today")
    ev = ev.where(s >= LEAST_SHARES)
    ev = ev.withColumn("__m", F.median(s).over(Window.partitionBy("corporate_id"))).where((s / F.col("__m")).between(0.01, 100))
    ev = ev.withColumn("__m", F.percentile(s, F.lit(0.5)).over(w.rowsBetween(-2, 2))).where((s / F.col("__m") > 0.5) & (s / F.col("__m") < 2.0))
    prev, nxt = F.lag(s).over(w), F.lead(s).over(w)
    blip = (F.abs(s / prev - 1) > 0.3) & (F.abs(nxt / prev - 1) < 0.1)
    return ev.withColumn("__blip", F.coalesce(blip, F.lit(False))).where("NOT __blip").drop("__m", "__blip")


def share_events(companies: DataFrame, sec: DataFrame, actions: DataFrame, prices: DataFrame, deals: DataFrame | None = None, stale_days: int = STALE_DAYS) -> DataFrame:
    """(corporate_id, d, shares_today, src): from when which count holds, all on today's split basis.

    companies: corporate_id, primary_ticker, yf_shares_outstanding. deals: corporate_id, d of completed acquisitions.
    """
    comp = companies.where("primary_ticker IS NOT NULL")
    rows = sec.join(comp.select("corporate_id", "primary_ticker"), "corporate_id")
    # product of the splits after each count's basis: total over the ticker by the product up to it
    splits = actions.where(F.abs(F.col("split_factor") - 1) > 1e-9).select(F.col("ticker").alias("primary_ticker"), F.col("date").alias("s_date"), F.ln("split_factor").alias("s_log"))
    run = splits.groupBy("primary_ticker", "s_date").agg(F.sum("s_log").alias("s_log")).withColumn("upto", F.sum("s_log").over(Window.partitionBy("primary_ticker").orderBy("s_date")))
    total = splits.groupBy("primary_ticker").agg(F.sum("s_log").alias("total"))
    rows = asof_join(rows, run.select("primary_ticker", "s_date", "upto"), "basis", "s_date", "primary_ticker").join(total, "primary_ticker", "left")
    rows = rows.withColumn("shares_today", F.col("shares") * F.exp(F.coalesce("total", F.lit(0.0)) - F.coalesce("upto", F.lit(0.0))))
    sec_rows = clean_sec_shares(rows.select("corporate_id", "primary_ticker", "d", "shares_today", "src"))
    out = sec_rows.select("corporate_id", "d", "shares_today", "src")
    if deals is not None:
        w = Window.partitionBy("corporate_id").orderBy("d")
        jumps = sec_rows.withColumn("p_d", F.lag("d").over(w)).withColumn("p_s", F.lag("shares_today").over(w))
        jumps = jumps.where(~(F.col("shares_today") / F.col("p_s")).between(0.83, 1.2))
        known = deals.select("corporate_id", F.col("d").alias("deal_date")).distinct()
        inside = asof_join(jumps, known, "d", "deal_date", "corporate_id", strict=True).where(F.col("deal_date") > F.col("p_d"))
        out = out.unionByName(inside.select("corporate_id", F.col("deal_date").alias("d"), "shares_today", F.lit("sec_after_deal").alias("src")))
    first = latest(out, "corporate_id", ["d"])
    out = out.unionByName(first.select("corporate_id", F.lit(FOREVER_AGO).cast("date").alias("d"), "shares_today", F.lit("sec_backfilled").alias("src")))
    ends = sec_rows.groupBy("corporate_id").agg(F.max("d").alias("last_sec"))
    last_price = prices.groupBy(F.col("ticker").alias("primary_ticker")).agg(F.max("date").alias("last_price"))
    now = comp.where("yf_shares_outstanding > 0").join(ends, "corporate_id", "left").join(last_price, "primary_ticker", "left")
    start = F.when(F.col("last_sec").isNull(), F.lit(FOREVER_AGO).cast("date")).when(F.col("last_price") > F.date_add("last_sec", stale_days), F.date_add("last_sec", stale_days))
    now = now.withColumn("d", start).where("d IS NOT NULL")
    return out.unionByName(now.select("corporate_id", "d", F.col("yf_shares_outstanding").cast("double").alias("shares_today"), F.lit("yfinance_current").alias("src")))


def market_cap(prices: DataFrame, companies: DataFrame, actions: DataFrame, events: DataFrame) -> DataFrame:
    """Daily market caps: real price (close by the factors after it) times the shares of that day's split basis."""
    comp = companies.where("primary_ticker IS NOT NULL").select("corporate_id", F.col("primary_ticker").alias("ticker"))
    px = prices.where("close IS NOT NULL").join(comp, "ticker").join(actions.select("ticker", "date", "yahoo_factor", "split_factor"), ["ticker", "date"], "left")
    px = px.withColumn("yahoo_after", suffix_product(F.coalesce("yahoo_factor", F.lit(1.0)), "ticker", "date")).withColumn("split_after", suffix_product(F.coalesce("split_factor", F.lit(1.0)), "ticker", "date"))
    if "price_suspect" in prices.columns:
        px = px.where(~F.coalesce("price_suspect", F.lit(False)))
    # of counts from one day the last kind written counts, as the later row does
    rank = F.when(F.col("src") == "sec_after_deal", 2).when(F.col("src") == "yfinance_current", 3).otherwise(1)
    ev = events.select("corporate_id", F.col("d").alias("from_day"), rank.alias("kind"), "shares_today", "src")
    m = asof_join(px, ev, "date", "from_day", "corporate_id", inner=True)
    real = F.col("close") * F.col("yahoo_after") / F.col("split_after")
    return m.select("corporate_id", "date", F.col("ticker").alias("primary_ticker"), (F.col("shares_today") / F.col("split_after")).alias("shares_outstanding"),
                    (real * F.col("shares_today") / fx.divisor("currency")).alias("market_cap"), fx.major("currency").alias("currency"),
                    (real * F.col("fx_to_usd") * F.col("shares_today")).alias("market_cap_usd"), F.col("src").alias("shares_source"))


def jump_check(caps: DataFrame, actions: DataFrame, limit: float = JUMP) -> DataFrame:
    """Days whose market cap moved by more than `limit` without a corporate action or a completed deal, with what moved it."""
    w = Window.partitionBy("corporate_id").orderBy("date")
    m = caps
    for c in ("market_cap", "date", "shares_outstanding", "shares_source"):
        m = m.withColumn(f"prev_{c}", F.lag(c).over(w))
    moved = F.abs(F.col("shares_outstanding") / F.col("prev_shares_outstanding") - 1)
    m = m.withColumn("change", F.try_divide("market_cap", "prev_market_cap") - 1).withColumn("driver", F.when(moved < 0.05, "price").otherwise("shares"))
    m = m.where((F.col("prev_market_cap") > 0) & (F.abs("change") > limit) & ~((F.col("shares_source") == "sec_after_deal") & ~F.col("prev_shares_source").eqNullSafe("sec_after_deal")))
    return m.join(actions.select(F.col("ticker").alias("primary_ticker"), "date").distinct(), ["primary_ticker", "date"], "left_anti")


def shares_check(caps: DataFrame, companies: DataFrame, limit: float = 0.2) -> DataFrame:
    """Companies whose latest count is off the current one by more than `limit`."""
    last = latest(caps, "corporate_id", F.desc("date")).join(companies.select("corporate_id", "yf_shares_outstanding"), "corporate_id")
    return last.withColumn("ratio", F.try_divide("shares_outstanding", F.col("yf_shares_outstanding").cast("double"))).where(F.abs(F.col("ratio") - 1) > limit)


def run(prices: DataFrame, companies: DataFrame, counts: DataFrame, current: DataFrame, deals: DataFrame | None = None, overrides: dict | None = None) -> dict[str, DataFrame]:
    """Actions, share events, market caps and both checks from their inputs."""
    comp = companies.where("primary_ticker IS NOT NULL")
    splits = prices.where("stock_splits > 0 AND stock_splits <> 1").select("ticker", "date", F.col("stock_splits").alias("yahoo_factor"))
    splits = splits.join(comp.select("corporate_id", F.col("primary_ticker").alias("ticker")), "ticker", "left")
    sec = sec_counts(counts)
    actions = classify_events(splits, sec, current, overrides)
    events = share_events(comp, sec, actions, prices, deals)
    caps = market_cap(prices, comp, actions, events)
    return {"actions": actions, "events": events, "market_cap": caps, "jumps": jump_check(caps, actions), "shares": shares_check(caps, comp)}
