"""The registry of companies and instruments: identifiers, currencies, countries, and the log of what was loaded."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.domain.fx import quote_currency

#: Countries by a ticker's exchange suffix; no suffix is the home market.
COUNTRIES = {"L": "GB", "DE": "DE", "F": "DE", "PA": "FR", "AS": "NL", "BR": "BE", "MI": "IT", "MC": "ES", "SW": "CH", "VI": "AT", "ST": "SE", "CO": "DK", "OL": "NO",
             "HE": "FI", "IR": "IE", "LS": "PT", "TO": "CA", "V": "CA", "AX": "AU", "NZ": "NZ", "T": "JP", "HK": "HK", "SS": "CN", "SZ": "CN", "KS": "KR", "TW": "TW",
             "SI": "SG", "NS": "IN", "BO": "IN", "SA": "BR", "MX": "MX", "JO": "ZA", "TA": "IL"}


def exchange_country(ticker: str, home: str = "US", countries: dict[str, str] = COUNTRIES) -> Column:
    """Country of a ticker's exchange by its suffix; null for a suffix that isn't known."""
    suffix = F.upper(F.regexp_extract(F.col(ticker), r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])
    return F.when(suffix == "", F.lit(home)).otherwise(F.try_element_at(table, suffix))


def fiscal_year_end(epoch_seconds: str) -> Column:
    """MMDD of a moment in seconds since 1970, in UTC."""
    return F.date_format(F.timestamp_seconds(F.col(epoch_seconds).cast("long")), "MMdd")


def resolve_ids(companies: DataFrame, overrides: DataFrame, tickers: DataFrame, names: DataFrame, by: str = "corporate_id") -> DataFrame:
    """companies (by, ticker, norm) with cik and method: override, ticker, name, or review where none of them knows it.

    overrides (by, cik), tickers (ticker, cik) and names (norm, cik) may hold a key more than once; the smallest cik counts, and a
    name that stands for several is no evidence.
    """
    once = lambda df, key, out: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("cik").alias(out), F.countDistinct("cik").alias(f"{out}_n"))
    x = companies.join(once(overrides, by, "__o"), by, "left").join(once(tickers, "ticker", "__t"), "ticker", "left").join(once(names, "norm", "__m"), "norm", "left")
    name = F.when(F.col("__m_n") == 1, F.col("__m"))
    method = F.when(F.col("__o").isNotNull(), "override").when(F.col("__t").isNotNull(), "ticker").when(name.isNotNull(), "name").otherwise("review")
    return x.select(*companies.columns, F.coalesce("__o", "__t", name).alias("cik"), method.alias("method"))


def fill_currency(prices: DataFrame, overrides: DataFrame, metadata: DataFrame) -> DataFrame:
    """prices with a currency for rows without one: the override's, else the pair's quote currency, else the metadata's.

    overrides and metadata: (ticker, currency), one row a ticker; a price's own currency always stays.
    """
    o, m = overrides.select("ticker", F.col("currency").alias("__o")), metadata.select("ticker", F.col("currency").alias("__m"))
    x = prices.join(o, "ticker", "left").join(m, "ticker", "left")
    return x.withColumn("currency", F.coalesce("currency", "__o", quote_currency("ticker"), "__m")).select(*prices.columns)


def rename_tickers(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """registry with the tickers of a list of corrections (old, new), one row an old ticker; others stay."""
    return registry.join(changes.select(F.col("old").alias("ticker"), "new"), "ticker", "left").withColumn("ticker", F.coalesce("new", "ticker")).select(*registry.columns)


def load_log(steps: DataFrame) -> DataFrame:
    """One row a step and run of (step, run, item, ok, rows, at): when it began and ended, its rows, and the items that failed in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("item"))))  # the list is part of the log
    return steps.groupBy("step", "run").agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"), F.count("*").alias("items"), F.sum("rows").alias("rows"),
        F.count_if(~F.col("ok")).alias("n_failed"), failed.alias("failed_items"))
