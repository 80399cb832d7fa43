"""FX rates and conversion to USD."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import col
from tidemark.operators.joins import asof_join

#: Minor units as quoted, with their currency and how many make one.
MINOR_UNITS = {"GBp": ("GBP", 100.0), "GBX": ("GBP", 100.0), "ZAc": ("ZAR", 100.0), "ILA": ("ILS", 100.0), "USX": ("USD", 100.0)}
EUR_PER_DEM = 1 / 1.95583
MAX_AGE_DAYS = 5
#: Instruments whose values are not money, by ticker, suffix and name.
NOT_MONEY_TICKERS = ("^IRX", "^FVX", "^TNX", "^TYX", "^SKEW", "^NYHL")
NOT_MONEY_SUFFIX = "_FRED"
NOT_MONEY_NAME = r"(?i)volatility index"


def base_currency(ticker) -> Column:
    """Base of an FX ticker: AAABBB=X quotes BBB per AAA, CCC=X quotes CCC per USD; null for other tickers."""
    code = F.upper(F.regexp_extract(col(ticker), r"^(.*)=X$", 1))
    return F.when(F.length(code) == 3, F.lit("USD")).when(F.length(code) == 6, F.substring(code, 1, 3))


def quote_currency(ticker) -> Column:
    code = F.upper(F.regexp_extract(col(ticker), r"^(.*)=X$", 1))
    return F.when(F.length(code) == 3, code).when(F.length(code) == 6, F.substring(code, 4, 3))


def usd_per_unit(ticker, currency, price) -> Column:
    """USD for one unit of currency by an FX ticker's price; null if the pair doesn't join the two or the price is zero."""
    base, quote, p = base_currency(ticker), quote_currency(ticker), F.nullif(col(price).cast("double"), F.lit(0.0))
    return F.when((base == col(currency)) & (quote == "USD"), p).when((base == "USD") & (quote == col(currency)), F.lit(1.0) / p)


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, m, d) for q, (m, d) in MINOR_UNITS.items()], "quoted string, major string, divisor double")


def major(quoted) -> Column:
    c = F.upper(col(quoted))
    for q, (m, _) in MINOR_UNITS.items():
        c = F.when(col(quoted) == q, F.lit(m)).otherwise(c)
    return c


def divisor(quoted) -> Column:
    c = F.lit(1.0)
    for q, (_, d) in MINOR_UNITS.items():
        c = F.when(col(quoted) == q, F.lit(d)).otherwise(c)
    return c


def choose_pairs(currencies: DataFrame, fx_tickers: DataFrame) -> DataFrame:
    """(currency, ticker, missing): CCYUSD=X before USDCCY=X before CCY=X; without any, CCY=X as a helper to be added."""
    wanted = currencies.where(F.col("currency").isNotNull() & (F.col("currency") != "USD")).distinct()
    forms = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(*parts).alias("ticker")) for i, parts in enumerate((
        (F.col("currency"), F.lit("USD=X")), (F.lit("USD"), F.col("currency"), F.lit("=X")), (F.col("currency"), F.lit("=X"))))])
    tried = wanted.select("currency", F.inline(forms)).join(fx_tickers.select("ticker").distinct().withColumn("there", F.lit(True)), "ticker", "left")
    best = tried.where("there").groupBy("currency").agg(F.min_by("ticker", "place").alias("found"))
    return wanted.join(best, "currency", "left").select("currency", F.coalesce("found", F.concat("currency", F.lit("=X"))).alias("ticker"), F.col("found").isNull().alias("missing"))


def business_days(df: DataFrame, start, end, out: str = "date") -> DataFrame:
    """A row for each Monday to Friday between two dates."""
    days = F.filter(F.sequence(col(start), col(end), F.expr("INTERVAL 1 DAY")), lambda d: F.weekday(d) < 5)
    return df.withColumn(out, F.explode(days))


def monthly_to_daily(obs: DataFrame, invert: bool = True, scale: float = 1.0) -> DataFrame:
    """Monthly averages (series keys, date, value) as the same rate on every business day of the month."""
    v = F.col("value").cast("double")
    rate = (F.lit(1.0) / F.nullif(v, F.lit(0.0)) if invert else v) / F.lit(scale)
    rows = obs.withColumn("rate", rate).where("rate IS NOT NULL").withColumn("month", F.trunc("date", "month"))
    rows = business_days(rows.drop("date"), "month", F.last_day("month"))
    return rows.drop("month", "value")


def peg_rates(spark: SparkSession, currency: str, value: float, start, end, note: str) -> DataFrame:
    one = spark.range(1).select(F.lit(currency).alias("currency"), F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return business_days(one, "a", "b").select("currency", "date", F.lit(float(value)).alias("usd_per_unit"), F.lit(note).alias("source"))


def combine_rates(parts: list[DataFrame], gap_days: int = MAX_AGE_DAYS) -> DataFrame:
    """(currency, date, usd_per_unit, source) of several sources, first ones first.

    A later source fills only days that none has, before the first day covered or more than gap_days after one.
    """
    names = ["currency", "date", "usd_per_unit", "source"]
    out = parts[0].select(*names).where("usd_per_unit IS NOT NULL")
    for more in parts[1:]:
        days = out.select("currency", F.col("date").alias("covered")).distinct()
        more = asof_join(more.select(*names).where("usd_per_unit IS NOT NULL"), days, "date", "covered", "currency")
        out = out.unionByName(more.where(F.col("covered").isNull() | (F.datediff("date", "covered") > gap_days)).select(*names))
    return out


def not_money(ticker, name=None) -> Column:
    c = col(ticker).isin(*NOT_MONEY_TICKERS) | col(ticker).endswith(NOT_MONEY_SUFFIX)
    return c | F.coalesce(col(name).rlike(NOT_MONEY_NAME), F.lit(False)) if name is not None else c


def apply_usd(prices: DataFrame, rates: DataFrame, columns=("close",), skip: Column | None = None, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """prices (ticker, date, currency, ...) with fx_to_usd and a *_usd column for each of columns.

    The rate in force is the last one of the major currency at most max_age days old; quotes in minor units are divided;
    USD is 1. Values that are not money (`skip`) get null.
    """
    p = prices.withColumn("__major", major("currency")).withColumn("__divisor", divisor("currency"))
    r = rates.select(F.col("currency").alias("__major"), F.col("date").alias("rate_date"), "usd_per_unit")
    out = asof_join(p, r, "date", "rate_date", "__major", max_age=max_age)
    rate = F.when(F.col("__major") == "USD", F.lit(1.0)).otherwise(F.col("usd_per_unit")) / F.col("__divisor")
    if skip is not None:
        rate = F.when(~skip, rate)
    out = out.withColumn("fx_to_usd", rate)
    return out.select(*prices.columns, *[(F.col(c) * F.col("fx_to_usd")).alias(f"{c}_usd") for c in columns], "fx_to_usd")


def gap_report(prices: DataFrame) -> DataFrame:
    """For each currency: rows, rows without a USD value, and the days between which they lie."""
    none = F.col("fx_to_usd").isNull() & F.col("close").isNotNull()
    return prices.groupBy(major("currency").alias("currency")).agg(
        F.count("*").alias("rows"), F.count_if(none).alias("rows_without_rate"), F.min(F.when(none, F.col("date"))).alias("first_gap"), F.max(F.when(none, F.col("date"))).alias("last_gap"))


def restated(stored: DataFrame, new: DataFrame, key: str, day: str, value: str, before, tol: float = 1e-4) -> DataFrame:
    """(key, changed): whether a re-read day before `before` differs from what is stored by more than tol, relatively."""
    s = stored.select(key, day, F.col(value).alias("__old"))
    j = new.select(key, day, value).join(s, [key, day]).where(F.col(day) < F.lit(before).cast("date"))
    off = F.abs(F.try_divide(F.col(value), F.col("__old")) - 1) > tol
    return j.groupBy(key).agg(F.coalesce(F.bool_or(off), F.lit(False)).alias("changed"))


def window_age(c, by, day, limit: int) -> Column:
    """Last value at most `limit` days old, as a range window, for tables that already hold every day."""
    w = Window.partitionBy(by).orderBy(F.unix_date(col(day))).rangeBetween(-limit, 0)
    return F.last(col(c), ignorenulls=True).over(w)
