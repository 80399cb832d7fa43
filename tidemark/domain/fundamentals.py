"""Statements from tagged filing facts, for all companies at once.

facts: company, tag, unit, start, end, val, accn, fy, fp. filings: company, accn, form, filed_date, report_date. Every rule is
a join, an aggregate or an expression over (company, filing, item): no company is looped over.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio
from tidemark.operators.windows import latest

TOLERANCE_DAYS = 7
#: Days of a quarter, half year, nine months and year.
BUCKETS = {"Q": (80, 105), "H": (165, 195), "N": (255, 290), "Y": (345, 380)}
ANNUAL, QUARTERLY = ("10-K", "20-F", "40-F"), ("10-Q", "6-K")
COVER, BALANCE = "EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding"

# Statement items with their kind (flow, stock or per share), unit, and public taxonomy tags, first ones first;
# tags of one rank are joined by a bar, and of these the largest value counts.
ITEMS = {
    "revenue": ("flow", "money", ["RevenueFromContractWithCustomerExcludingAssessedTax|Revenues|SalesRevenueNet|SalesRevenueGoodsNet", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueServicesNet"]),
    "cost_of_revenue": ("flow", "money", ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices"]),
    "gross_profit": ("flow", "money", ["GrossProfit"]),
    "rnd_expense": ("flow", "money", ["ResearchAndDevelopmentExpense"]),
    "sga_expense": ("flow", "money", ["SellingGeneralAndAdministrativeExpense"]),
    "operating_expenses": ("flow", "money", ["OperatingExpenses", "CostsAndExpenses"]),
    "operating_income": ("flow", "money", ["OperatingIncomeLoss"]),
    "interest_expense": ("flow", "money", ["InterestExpense"]),
    "income_tax": ("flow", "money", ["IncomeTaxExpenseBenefit"]),
    "net_income": ("flow", "money", ["NetIncomeLoss", "ProfitLoss"]),
    "net_income_to_common": ("flow", "money", ["NetIncomeLossAvailableToCommonStockholdersBasic"]),
    "depreciation_amortization": ("flow", "money", ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization"]),
    "operating_cash_flow": ("flow", "money", ["NetCashProvidedByUsedInOperatingActivities"]),
    "investing_cash_flow": ("flow", "money", ["NetCashProvidedByUsedInInvestingActivities"]),
    "financing_cash_flow": ("flow", "money", ["NetCashProvidedByUsedInFinancingActivities"]),
    "capex": ("flow", "money", ["PaymentsToAcquirePropertyPlantAndEquipment"]),
    "dividends_paid": ("flow", "money", ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"]),
    "share_buybacks": ("flow", "money", ["PaymentsForRepurchaseOfCommonStock"]),
    "cash": ("stock", "money", ["CashAndCashEquivalentsAtCarryingValue"]),
    "total_assets": ("stock", "money", ["Assets"]),
    "total_liabilities": ("stock", "money", ["Liabilities"]),
    "total_equity": ("stock", "money", ["StockholdersEquity"]),
    "noncontrolling_interest": ("stock", "money", ["MinorityInterest"]),
    "redeemable_equity": ("stock", "money", ["TemporaryEquityCarryingAmountAttributableToParent"]),
    "short_term_debt": ("stock", "money", ["DebtCurrent", "ShortTermBorrowings"]),
    "long_term_debt": ("stock", "money", ["LongTermDebtNoncurrent", "LongTermDebt"]),
    "inventory": ("stock", "money", ["InventoryNet"]),
    "eps_basic": ("per", "per_share", ["EarningsPerShareBasic"]),
    "eps_diluted": ("per", "per_share", ["EarningsPerShareDiluted"]),
    "shares_basic_wavg": ("per", "shares", ["WeightedAverageNumberOfSharesOutstandingBasic"]),
    "shares_diluted_wavg": ("per", "shares", ["WeightedAverageNumberOfDilutedSharesOutstanding"]),
    "_rev_excl_tax": ("flow", "money", ["RevenueFromContractWithCustomerExcludingAssessedTax"]),
    "_rev_incl_tax": ("flow", "money", ["RevenueFromContractWithCustomerIncludingAssessedTax"]),
    "_excise": ("flow", "money", ["ExciseAndSalesTaxes"]),
    "_other_cost": ("flow", "money", ["OtherCostAndExpenseOperating"]),
    "_equity_incl_nci": ("stock", "money", ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
}
INTERNAL = [i for i in ITEMS if i.startswith("_")]


def tag_table(spark: SparkSession, items: dict = ITEMS) -> DataFrame:
    rows = [(item, kind, unit, rank, tag) for item, (kind, unit, ranks) in items.items() for rank, tags in enumerate(ranks) for tag in tags.split("|")]
    return spark.createDataFrame(rows, "item string, kind string, unit_type string, rank int, tag string")


def base_form(form):
    return F.regexp_replace(form, "/A$", "")


def choose_filings(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """One filing for each (company, fiscal year, period): the original before amendments, then the earliest."""
    meta = facts.where("fy IS NOT NULL AND fp IS NOT NULL").groupBy("company", "accn").agg(F.mode("fy", True).alias("fy"), F.mode("fp", True).alias("fp"), F.max("end").alias("max_end"))
    p = filings.dropDuplicates(["company", "accn"]).where(base_form("form").isin(*ANNUAL, *QUARTERLY)).join(meta, ["company", "accn"])
    p = p.withColumn("period_end", F.coalesce("report_date", "max_end")).withColumn("amended", F.col("form").endswith("/A")).where(F.col("fp").isin("Q1", "Q2", "Q3", "FY"))
    return latest(fix_labels(p), ["company", "fy", "fp"], ["amended", "filed_date", "accn"]).drop("amended", "max_end")


def fix_labels(p: DataFrame) -> DataFrame:
    """Drops annual filings off the company's usual year-end month and repairs fiscal years far from their period."""
    fy = p.where("fp = 'FY'")
    month = fy.groupBy("company").agg(F.mode(F.month("period_end"), True).alias("__month"))
    off = fy.withColumn("__o", F.col("fy") - F.year("period_end")).where(F.col("__o").isin(-1, 0)).groupBy("company").agg(F.mode("__o", True).alias("__offset"))
    x = p.join(month, "company", "left").join(off, "company", "left")
    gap = F.pmod(F.month("period_end") - F.col("__month"), F.lit(12))
    x = x.where(~F.coalesce((F.col("fp") == "FY") & gap.between(2, 10), F.lit(False)))
    expected = F.year("period_end") + (F.month("period_end") > F.col("__month")).cast("int") + F.coalesce("__offset", F.lit(0))
    wrong = F.coalesce((F.col("fy") != expected) & (F.abs(F.col("fy") - F.year("period_end")) >= 2), F.lit(False))
    return x.withColumn("fy", F.when(wrong, expected).otherwise(F.col("fy")).cast("int")).drop("__month", "__offset")


def filing_values(facts: DataFrame, chosen: DataFrame, tags: DataFrame) -> DataFrame:
    """(company, accn, item, kind, bucket, val, start, unit): the best tag's value for each duration of the filing's own period."""
    f = facts.dropDuplicates(["company", "accn", "tag", "unit", "start", "end", "val"]).join(F.broadcast(tags), "tag")
    f = f.join(chosen.select("company", "accn", "period_end"), ["company", "accn"]).withColumn("__dist", F.abs(F.datediff("end", "period_end"))).where(F.col("__dist") <= TOLERANCE_DAYS)
    u = F.col("unit")
    f = f.where(((F.col("unit_type") == "money") & u.rlike("^[A-Z]{3}$")) | ((F.col("unit_type") == "per_share") & u.endswith("/shares")) | ((F.col("unit_type") == "shares") & (u == "shares")))
    days = F.datediff("end", "start")
    bucket = F.when(F.col("start").isNull(), F.when(F.col("kind") == "stock", "I"))
    for b, (lo, hi) in BUCKETS.items():
        bucket = bucket.when((F.col("kind") != "stock") & days.between(lo, hi), b)
    f = f.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    return latest(f, ["company", "accn", "item", "bucket"], ["rank", "__dist", F.desc("val")]).select("company", "accn", "item", "kind", "bucket", "val", "start", "unit")


def cover_shares(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(company, accn, shares_outstanding, shares_as_of): classes of the cover page summed at its last date, else the balance sheet."""
    s = facts.where(F.col("unit") == "shares").join(chosen.select("company", "accn", "period_end"), ["company", "accn"])
    cover = s.where(F.col("tag") == COVER)
    last = cover.groupBy("company", "accn").agg(F.max("end").alias("end"))
    cover = cover.join(last, ["company", "accn", "end"]).select("company", "accn", "end", "val").distinct().groupBy("company", "accn").agg(F.sum("val").alias("c_val"), F.first("end").alias("c_end"))
    bal = s.where((F.col("tag") == BALANCE) & (F.abs(F.datediff("end", "period_end")) <= TOLERANCE_DAYS))
    bal = latest(bal, ["company", "accn"], ["end", "val"]).select("company", "accn", F.col("val").alias("b_val"), F.col("end").alias("b_end"))
    out = cover.join(bal, ["company", "accn"], "full")
    return out.select("company", "accn", F.coalesce("c_val", "b_val").alias("shares_outstanding"), F.coalesce("c_end", "b_end").alias("shares_as_of"))


def assemble(chosen: DataFrame, values: DataFrame, shares: DataFrame, items: dict = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Wide quarterly and yearly rows. Flows reported year to date become quarters by differences; the fourth quarter is the
    year less nine months; a missing filing breaks the chain."""
    v = values.join(chosen.select("company", "accn", "fy", "fp"), ["company", "accn"])
    at = lambda fp, b: F.max(F.when((F.col("fp") == fp) & (F.col("bucket") == b), F.col("val")))
    g = v.groupBy("company", "fy", "item", "kind").agg(*[at(fp, b).alias(f"{fp}{b}") for fp, bs in {"Q1": "QI", "Q2": "QHI", "Q3": "QNI", "FY": "YI"}.items() for b in bs])
    g = g.withColumn("y1", F.col("Q1Q"))
    g = g.withColumn("q2", F.coalesce("Q2Q", F.col("Q2H") - F.col("y1"))).withColumn("y2", F.coalesce("Q2H", F.col("y1") + F.col("q2")))
    g = g.withColumn("q3", F.coalesce("Q3Q", F.col("Q3N") - F.col("y2"))).withColumn("y3", F.coalesce("Q3N", F.col("y2") + F.col("q3")))
    by_kind = lambda flow, per, stock: F.when(F.col("kind") == "stock", stock).when(F.col("kind") == "per", per).otherwise(flow)
    none = F.lit(None).cast("double")
    quarters = F.array(*[F.struct(F.lit(n).alias("fq"), by_kind(flow, per, stock).alias("val")) for n, flow, per, stock in (
        (1, F.col("Q1Q"), F.col("Q1Q"), F.col("Q1I")), (2, F.col("q2"), F.col("Q2Q"), F.col("Q2I")), (3, F.col("q3"), F.col("Q3Q"), F.col("Q3I")), (4, F.col("FYY") - F.col("y3"), none, F.col("FYI")))])
    names = list(items)
    q = g.select("company", "fy", "item", F.inline(quarters)).groupBy("company", "fy", "fq").pivot("item", names).agg(F.max("val"))
    y = g.select("company", "fy", "item", F.when(F.col("kind") == "stock", F.col("FYI")).otherwise(F.col("FYY")).alias("val")).groupBy("company", "fy").pivot("item", names).agg(F.max("val"))
    money = values.where(F.col("unit").rlike("^[A-Z]{3}$")).groupBy("company", "accn").agg(F.when(F.bool_or(F.col("unit") == "USD"), "USD").otherwise(F.mode("unit", True)).alias("currency"))
    starts = values.where(F.col("bucket").isin("Q", "Y")).groupBy("company", "accn").agg(F.mode(F.when(F.col("bucket") == "Q", F.col("start")), True).alias("q_start"), F.mode(F.when(F.col("bucket") == "Y", F.col("start")), True).alias("y_start"))
    meta = chosen.join(money, ["company", "accn"], "left").join(shares, ["company", "accn"], "left").join(starts, ["company", "accn"], "left")
    keep = ["company", "fy", "period_end", "filed_date", "form", "accn", "currency", "shares_outstanding", "shares_as_of"]
    yearly = meta.where("fp = 'FY'").select(*keep, F.col("y_start").alias("period_start")).join(y, ["company", "fy"], "left")
    number = F.when(F.col("fp") == "FY", 4).otherwise(F.substring("fp", 2, 1).cast("int"))
    w = Window.partitionBy("company", "fy").orderBy("fq")
    m = meta.withColumn("fq", number)
    # the end of the quarter before, if it was filed
    prev = F.when(F.lag("fq").over(w) == F.col("fq") - 1, F.lag("period_end").over(w))
    m = m.withColumn("period_start", F.coalesce(F.when(F.col("fq") < 4, F.col("q_start")), F.date_add(prev, 1)))
    quarterly = m.select(*keep, "fq", "period_start", (F.col("fq") == 4).alias("q4_derived")).join(q, ["company", "fy", "fq"], "left")
    return quarterly, yearly


def resolve_revenue_and_equity(df: DataFrame) -> DataFrame:
    """Revenue net of excise taxes where the facts tell it apart from gross, equity parts completed, gross profit derived."""
    rev, a, b, cogs, gp, tag, other = (F.col(c) for c in ("revenue", "_rev_excl_tax", "_rev_incl_tax", "cost_of_revenue", "gross_profit", "_excise", "_other_cost"))
    close = lambda x, y: F.abs(x - y) <= 0.01 * F.abs(rev)
    both = (a != b) & ((rev == a) | (rev == b))
    resid, excise = rev - cogs - gp, F.coalesce(tag, other)
    was_gross, was_net = (excise > 0) & close(resid, excise), (tag > 0) & close(resid, F.lit(0.0))
    out = df.withColumn("__net", F.when(both, F.least(a, b)).when(was_gross, rev - excise).otherwise(rev))
    out = out.withColumn("revenue_incl_excise", F.when(both, F.greatest(a, b)).when(was_gross, rev).when(was_net, rev + tag)).withColumn("revenue", F.col("__net")).drop("__net")
    incl = F.col("_equity_incl_nci")
    out = out.withColumn("total_equity", F.coalesce("total_equity", incl - F.col("noncontrolling_interest")))
    out = out.withColumn("noncontrolling_interest", F.coalesce("noncontrolling_interest", incl - F.col("total_equity")))
    out = out.withColumn("gross_profit_derived", F.col("gross_profit").isNull() & (F.col("revenue") - F.col("cost_of_revenue")).isNotNull())
    return out.withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))).drop(*INTERNAL)


def fix_share_scale(df: DataFrame) -> DataFrame:
    """Share counts tagged in thousands or millions, found by net income over shares against the reported figure a share."""
    ni, fixed, out = F.coalesce("net_income_to_common", "net_income"), F.lit(False), df
    for shares, eps in (("shares_diluted_wavg", "eps_diluted"), ("shares_basic_wavg", "eps_basic")):
        k = F.when((F.col(shares) > 0) & (F.abs(F.col(eps)) >= 0.05), ni / F.col(shares) / F.col(eps))
        hit = F.when(F.abs(k / 1e3 - 1) < 0.05, 1e3).when(F.abs(k / 1e6 - 1) < 0.05, 1e6)
        out = out.withColumn(f"__{shares}", hit)
        fixed = fixed | F.col(f"__{shares}").isNotNull()
    out = out.withColumn("shares_scale_fixed", fixed)
    for shares in ("shares_diluted_wavg", "shares_basic_wavg"):
        out = out.withColumn(shares, F.col(shares) * F.coalesce(f"__{shares}", F.lit(1.0))).drop(f"__{shares}")
    return out


def add_derived(df: DataFrame) -> DataFrame:
    """Sums and margins, null where an input is missing or revenue is zero."""
    c = F.col
    out = df.withColumn("ebitda", c("operating_income") + c("depreciation_amortization")).withColumn("total_debt", c("short_term_debt") + c("long_term_debt"))
    out = out.withColumn("net_debt", c("total_debt") - c("cash")).withColumn("free_cash_flow", c("operating_cash_flow") - c("capex"))
    for name, part in (("gross_margin", "gross_profit"), ("operating_margin", "operating_income"), ("net_margin", "net_income")):
        out = out.withColumn(name, ratio(part, "revenue"))
    return out


def build(facts: DataFrame, filings: DataFrame, items: dict = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Quarterly and yearly statements of every company."""
    chosen = choose_filings(facts, filings)
    values = filing_values(facts, chosen, tag_table(facts.sparkSession, items))
    q, y = assemble(chosen, values, cover_shares(facts, chosen), items)
    finish = lambda d: add_derived(fix_share_scale(resolve_revenue_and_equity(d)))
    return finish(q), finish(y)


def checks(df: DataFrame) -> DataFrame:
    """(company, fy, check, value, expected): balance, gross profit and earnings a share that don't add up."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = F.col("total_liabilities") + zero("redeemable_equity") + zero("noncontrolling_interest") + F.col("total_equity")
    gp = F.col("revenue") - F.col("cost_of_revenue")
    eps = F.coalesce("net_income_to_common", "net_income") / F.when(F.col("shares_diluted_wavg") > 0, F.col("shares_diluted_wavg"))
    off = lambda x, y, scale, tol: F.abs(x - y) > tol * F.abs(scale)
    found = F.array(
        F.when((F.col("total_assets") != 0) & off(F.col("total_assets"), parts, F.col("total_assets"), 0.01), F.struct(F.lit("balance").alias("check"), F.col("total_assets").alias("value"), parts.alias("expected"))),
        F.when(~F.col("gross_profit_derived") & (F.col("revenue") != 0) & off(F.col("gross_profit"), gp, F.col("revenue"), 0.01), F.struct(F.lit("gross_profit").alias("check"), F.col("gross_profit").alias("value"), gp.alias("expected"))),
        F.when((F.abs("eps_diluted") >= 0.05) & off(eps, F.col("eps_diluted"), F.col("eps_diluted"), 0.05) & (F.abs(eps - F.col("eps_diluted")) > 0.01), F.struct(F.lit("eps").alias("check"), eps.alias("value"), F.col("eps_diluted").alias("expected"))))
    return df.select("company", "fy", F.inline(F.filter(found, lambda x: x.isNotNull())))


def revenue_jumps(yearly: DataFrame, low: float = -0.9, high: float = 4.0) -> DataFrame:
    """Years whose revenue changed beyond the limits against the year before."""
    w = Window.partitionBy("company").orderBy("fy")
    x = yearly.where("revenue IS NOT NULL").withColumn("prev", F.lag("revenue").over(w)).withColumn("prev_year", F.lag("fy").over(w)).where("prev_year = fy - 1")
    change = ratio("revenue", "prev") - 1
    return x.where((change < low) | (change > high)).select("company", "fy", F.lit("revenue_jump").alias("check"), F.col("revenue").alias("value"), F.col("prev").alias("expected"))
