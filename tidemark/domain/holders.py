"""Institutional holdings: filings in force, matching issuers to companies, ownership by fiscal quarter."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import col, ratio
from tidemark.functions.text import cusip_valid, name_similarity, norm_name
from tidemark.operators.joins import asof_join, nearest_join
from tidemark.operators.windows import latest

#: Values are in dollars from this filing date on, in thousands before.
DOLLARS_FROM = "2023-01-03"
LEAST_ROWS, SIMILAR, TOP, GAP_DAYS = 20, 0.85, 20, 45
#: Words that an issuer's name may have beyond the company's.
HARMLESS = ("ireland", "del", "hldgs", "hldg", "cl", "com", "inc", "corp", "grp", "intl", "plc", "ltd", "usa", "us", "the", "n", "v", "sa", "new")
NOT_COMMON = r"PFD|PREF|NOTE|WARRANT|\bWT|CALL|PUT|OPT|DEBT|BOND"


def report_periods(quarters: DataFrame, n: int, today, deadline_days: int = 45) -> DataFrame:
    """The latest n quarter ends whose filing deadline is over."""
    done = quarters.where(F.date_add("period", deadline_days) <= F.lit(today).cast("date"))
    return done.select("period").distinct().orderBy(F.desc("period")).limit(n)


def holdings(submission: DataFrame, coverpage: DataFrame, infotable: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, filer_cik, cusip, manager, issuer, title, shares, value_usd) of the filings in force.

    The last original or restatement of a filer and period counts, with the new holdings filed on or after it.
    """
    f = submission.distinct().join(coverpage.distinct(), "accession").join(F.broadcast(periods.select("period").distinct()), "period")
    kind = F.when(F.col("submission_type") == "13F-HR", "original").when(F.col("submission_type") == "13F-HR/A", F.when(F.col("amendment_type").like("RESTATEMENT%"), "restatement").when(F.col("amendment_type").like("NEW HOLDINGS%"), "new_holdings"))
    f = f.withColumn("kind", kind).where("kind IS NOT NULL")
    base = latest(f.where("kind <> 'new_holdings'"), ["filer_cik", "period"], [F.desc("filing_date"), F.desc("accession")])
    base = base.select("accession", "filing_date", "filer_cik", "period", "manager")
    more = f.where("kind = 'new_holdings'").select("accession", "filing_date", "filer_cik", "period").join(base.select("filer_cik", "period", F.col("filing_date").alias("since"), "manager"), ["filer_cik", "period"]).where("filing_date >= since")
    used = base.unionByName(more.drop("since"))
    i = used.join(infotable.distinct(), "accession").where("shares > 0")
    scale = F.when(F.col("filing_date") < F.lit(DOLLARS_FROM).cast("date"), 1000).otherwise(1)
    return i.groupBy("period", "filer_cik", "cusip").agg(F.max("manager").alias("manager"), F.max("issuer").alias("issuer"), F.max("title").alias("title"), F.sum("shares").alias("shares"), F.sum(F.col("value") * scale).alias("value_usd"))


def common_stock(cusip, title) -> Column:
    """A valid CUSIP of numeric issue code below 90 whose title names no other security."""
    issue = F.substring(col(cusip), 7, 2).try_cast("int")
    return cusip_valid(cusip) & F.coalesce(issue < 90, F.lit(False)) & ~F.coalesce(F.upper(col(title)).rlike(NOT_COMMON), F.lit(False))


def abbreviates(short: str, word: str) -> bool:
    """short stands for word: equal, its beginning, or three letters and more, the first alike, in word's order."""
    if short == word or (len(short) >= 2 and word.startswith(short)):
        return True
    rest = iter(word)
    return len(short) >= 3 and short[0] == word[0] and all(ch in rest for ch in short)


@F.pandas_udf(T.BooleanType())
def name_abbreviates(issuer: pd.Series, company: pd.Series) -> pd.Series:
    """Every company word is abbreviated by an issuer word of its own, and at most two harmless words are left."""
    out = []
    for a, b in zip(issuer, company, strict=True):
        left, ok = (a or "").split(), bool(a) and bool(b)
        for w in (b or "").split():
            t = next((t for t in left if abbreviates(t, w)), None)
            if t is None:
                ok = False
                break
            left.remove(t)
        out.append(ok and len(left) <= 2 and all(x in HARMLESS for x in left))
    return pd.Series(out)


def match_companies(h: DataFrame, companies: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(cusip, corporate_id, method): override, CUSIP of the ISIN widened to its issuer code, exact name, abbreviation, similar name.

    companies: corporate_id, name, cusip. Stages go in order; what a stage has claimed is out of the later ones, and of
    several companies for one CUSIP the smallest id counts. Names are compared within their first letter or word.
    """
    newest = h.agg(F.max("period").alias("newest"))
    c = h.crossJoin(F.broadcast(newest)).groupBy("cusip").agg(F.max("issuer").alias("issuer"), F.max("title").alias("title"), F.count("*").alias("n"), F.count_if(F.col("period") == F.col("newest")).alias("n_latest"))
    c = c.where(common_stock("cusip", "title")).withColumn("issuer6", F.substring("cusip", 1, 6)).withColumn("norm", norm_name("issuer"))
    co = companies.withColumn("key", norm_name("name"))
    done = (overrides.select("cusip", "corporate_id", F.lit("override").alias("method")) if overrides is not None else c.select("cusip", F.lit(None).cast("int").alias("corporate_id"), F.lit("").alias("method")).limit(0))

    def claim(found: DataFrame, method: str, done: DataFrame) -> DataFrame:
        free = found.join(done.select("cusip"), "cusip", "left_anti").join(done.select("corporate_id").distinct(), "corporate_id", "left_anti")
        return done.unionByName(free.groupBy("cusip").agg(F.min("corporate_id").alias("corporate_id")).select("cusip", "corporate_id", F.lit(method).alias("method")))

    by_isin = co.where("cusip IS NOT NULL").select(F.substring("cusip", 1, 6).alias("issuer6"), "corporate_id", "key")
    done = claim(c.join(by_isin, "issuer6").where((F.col("norm") == F.col("key"))).select("cusip", "corporate_id").unionByName(c.join(co.select("cusip", "corporate_id"), "cusip").select("cusip", "corporate_id")).distinct(), "isin", done)
    named = latest(c.where((F.col("n") >= LEAST_ROWS) & (F.col("norm") != "")), "norm", [F.desc("n_latest"), F.desc("n"), "cusip"])
    done = claim(named.join(co.select(F.col("key").alias("norm"), "corporate_id"), "norm").select("cusip", "corporate_id"), "name", done)
    letter = named.withColumn("a", F.substring("norm", 1, 1)).join(co.withColumn("a", F.substring("key", 1, 1)).select("a", "key", "corporate_id"), "a")
    short = latest(letter.where(name_abbreviates("norm", "key")), "corporate_id", [F.desc("n"), "cusip"])
    done = claim(short.select("cusip", "corporate_id"), "abbreviation", done)
    word = named.withColumn("a", F.element_at(F.split("norm", " "), 1)).join(co.withColumn("a", F.element_at(F.split("key", " "), 1)).select("a", "key", "corporate_id"), "a")
    alike = word.withColumn("s", name_similarity("norm", "key")).where(F.col("s") >= SIMILAR)
    return claim(latest(alike, "corporate_id", [F.desc("s"), F.desc("n"), "cusip"]).select("cusip", "corporate_id"), "similar", done)


def holder_group(name, groups: list[tuple[str, str]]) -> Column:
    """The first group whose pattern the upper-case name has."""
    out = F.lit(None).cast("string")
    for g, pattern in reversed(groups):
        out = F.when(F.upper(col(name)).rlike(pattern), g).otherwise(out)
    return out


def ownership(h: DataFrame, mapping: DataFrame, shares: DataFrame, quarters: DataFrame, groups=()) -> DataFrame:
    """(corporate_id, fiscal_year, fiscal_quarter, inst_pct, n_holders, top_holders) by the nearest fiscal quarter end.

    A holder's change needs a comparable report a quarter earlier: one with at least a tenth of its present positions.
    shares: corporate_id, date, shares_outstanding. quarters: corporate_id, fiscal_year, fiscal_quarter, period_end.
    """
    positions = h.groupBy("filer_cik", "period").agg(F.count("*").alias("n"))
    a = h.join(mapping.select("cusip", "corporate_id"), "cusip").groupBy("corporate_id", "period", "filer_cik").agg(F.max("manager").alias("manager"), F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"))
    a = a.withColumn("prev_period", F.last_day(F.add_months("period", -3)))
    before = a.select("corporate_id", "filer_cik", F.col("period").alias("prev_period"), F.col("shares").alias("prev_shares"))
    a = a.join(before, ["corporate_id", "filer_cik", "prev_period"], "left").join(positions, ["filer_cik", "period"]).join(positions.select("filer_cik", F.col("period").alias("prev_period"), F.col("n").alias("n_prev")), ["filer_cik", "prev_period"], "left")
    a = a.withColumn("change", F.when(F.col("n_prev") >= 0.1 * F.col("n"), F.col("shares") - F.coalesce("prev_shares", F.lit(0.0))))
    out = asof_join(a.select("corporate_id", "period").distinct(), shares.select("corporate_id", F.col("date").alias("s_date"), "shares_outstanding"), "period", "s_date", "corporate_id")
    quarter = nearest_join(out, quarters, "corporate_id", "period", "period_end", GAP_DAYS, ["fiscal_year", "fiscal_quarter"])
    a = a.join(quarter.select("corporate_id", "period", "shares_outstanding", "fiscal_year", "fiscal_quarter"), ["corporate_id", "period"]).where("fiscal_year IS NOT NULL")
    a = a.withColumn("pct", 100 * ratio("shares", "shares_outstanding")).withColumn("holder_group", holder_group("manager", list(groups)))
    a = a.withColumn("rn", F.row_number().over(Window.partitionBy("corporate_id", "period").orderBy(F.desc("shares"), "filer_cik")))
    one = F.struct("rn", F.col("manager").alias("holder_name"), "holder_group", "shares", "value_usd", F.col("pct").alias("pct_of_shares_out"), "change")
    g = a.groupBy("corporate_id", "fiscal_year", "fiscal_quarter", "period").agg(F.sum("pct").alias("inst_pct"), F.count("*").alias("n_holders"), F.sort_array(F.collect_list(F.when(F.col("rn") <= TOP, one))).alias("top_holders"))
    return g
