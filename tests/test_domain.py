"""Worked examples of the domain operators, inputs small enough to read."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.domain import fundamentals as fu
from tidemark.domain import fx, intraday, marketcap, prices


def D(s):
    return date.fromisoformat(s)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_usd_conversion(spark):
    p = spark.createDataFrame([("7203.T", D("2026-09-25"), 2989.5, "JPY"), ("SHEL.L", D("2026-09-25"), 3611.0, "GBp"), ("SAP.DE", D("2026-09-25"), 200.0, "EUR"), ("SAP.DE", D("2026-09-29"), 201.0, "EUR"),
                               ("SAP.DE", D("2026-10-05"), 202.0, "EUR"), ("AAPL", D("2026-09-25"), 250.0, "USD"), ("^TNX", D("2026-09-25"), 4.2, "USD")], "ticker string, date date, close double, currency string")
    rates = spark.createDataFrame([(c, D("2026-09-25"), v) for c, v in (("JPY", 1 / 150), ("GBP", 1.35), ("EUR", 1.10))], "currency string, date date, usd_per_unit double")
    out = rows(fx.apply_usd(p, rates, skip=fx.not_money("ticker")), "ticker", "date")
    assert out["7203.T", D("2026-09-25")].close_usd == pytest.approx(2989.5 / 150)
    assert out["SHEL.L", D("2026-09-25")].close_usd == pytest.approx(36.11 * 1.35)
    assert out["SHEL.L", D("2026-09-25")].fx_to_usd == pytest.approx(1.35 / 100)
    assert out["SAP.DE", D("2026-09-29")].close_usd == pytest.approx(201 * 1.10)
    assert out["SAP.DE", D("2026-10-05")].close_usd is None and out["SAP.DE", D("2026-10-05")].fx_to_usd is None
    assert out["AAPL", D("2026-09-25")].close_usd == 250.0 and out["^TNX", D("2026-09-25")].close_usd is None


def test_monthly_rates_and_gap_filling(spark):
    m = spark.createDataFrame([("PLN", D("2000-01-01"), 4.0), ("PLN", D("2000-02-01"), 5.0)], "currency string, date date, value double")
    got = {r.date: r.rate for r in fx.monthly_to_daily(m).collect()}
    assert got[D("2000-01-31")] == 0.25 and got[D("2000-02-15")] == 0.20 and D("2000-01-15") not in got
    s = "currency string, date date, usd_per_unit double, source string"
    a = spark.createDataFrame([("HKD", D("2024-05-01"), 0.128, "y"), ("HKD", D("2024-05-06"), 0.128, "y"), ("HKD", D("2024-12-01"), 0.128, "y")], s)
    b = spark.createDataFrame([("HKD", D(d), 0.129, "f") for d in ("2024-04-30", "2024-05-02", "2024-05-09", "2024-05-12", "2024-11-28")], s)
    filled = {r.date for r in fx.combine_rates([a, b]).collect() if r.source == "f"}
    assert filled == {D("2024-04-30"), D("2024-05-12"), D("2024-11-28")}


def test_pairs(spark):
    c = spark.createDataFrame([("EUR",), ("JPY",), ("CHF",), ("USD",)], "currency string")
    t = spark.createDataFrame([("EURUSD=X",), ("JPY=X",)], "ticker string")
    assert {(r.currency, r.ticker, r.missing) for r in fx.choose_pairs(c, t).collect()} == {("EUR", "EURUSD=X", False), ("JPY", "JPY=X", False), ("CHF", "CHF=X", True)}
    r = spark.range(1).select(fx.usd_per_unit(F.lit("EURUSD=X"), F.lit("EUR"), F.lit(1.1)).alias("a"), fx.usd_per_unit(F.lit("JPY=X"), F.lit("JPY"), F.lit(150.0)).alias("b"), fx.usd_per_unit(F.lit("EURUSD=X"), F.lit("GBP"), F.lit(1.1)).alias("c")).first()
    assert r.a == 1.1 and r.b == pytest.approx(1 / 150) and r.c is None


@pytest.mark.parametrize(("values", "factors"), [
    ([1500, 1510, 15.2, 15.3, 1540, 1550], [1, 1, 100, 100, 1, 1]), ([14.9, 15.0, 1505, 1510], [100, 100, 1, 1]), ([1500, 151000, 1505], [1, 0.01, 1]), ([100, 60, 110, 3000], [1, 1, 1, 1])])
def test_unit_factors(spark, values, factors):
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(values)], "ticker string, date int, close double")
    assert [r.unit_factor for r in prices.unit_factors(df).orderBy("date").collect()] == pytest.approx(factors)


@pytest.mark.parametrize(("values", "days"), [
    ([100, 5100, 99, 100, 101, 10.5, 102, 103], [1, 5]), ([100, 200, 205, 198, 101, 102], [1, 2, 3]), ([100, 65, 70, 72, 75, 74], []), ([100, 60, 80, 85, 90], []), ([100, 140, 145, 150, 155, 100], [])])
def test_spikes(values, days):
    assert [i for i, s in enumerate(prices._spikes([float(v) for v in values])) if s] == days


def _session(spark, day, first, last, price=100.0):
    return spark.sql(f"SELECT 'T' AS ticker, to_utc_timestamp(timestamp'{day} 00:00:00', 'America/New_York') + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, {price}D AS open, {price}D + 1 AS high, {price}D - 1 AS low, {price}D AS close, 10.0D AS volume, {price}D AS vwap, 2L AS trade_count FROM range({first}, {last})")


def test_session_bars(spark):
    full = _session(spark, "2026-09-25", 570, 960)
    h = intraday.resample(intraday.regular_hours(full), 60).select(F.date_format(intraday.new_york("ts"), "HH:mm").alias("t"), "volume").orderBy("t").collect()
    assert [(r.t, r.volume) for r in h] == [(f"{9 + k:02d}:30", 600.0) for k in range(6)] + [("15:30", 300.0)]
    early = _session(spark, "2026-11-27", 570, 781)
    h = intraday.resample(intraday.regular_hours(early), 60).orderBy("ts").collect()
    assert len(h) == 4 and h[-1].volume == 310.0


def test_vwap_and_sparse_bars(spark):
    m = spark.sql("SELECT 'T' AS ticker, to_utc_timestamp(t, 'America/New_York') AS ts, p AS open, p + 1 AS high, p - 1 AS low, p AS close, v AS volume, p AS vwap, 2L AS trade_count FROM VALUES (timestamp'2026-09-25 09:30:00', 100D, 100D), (timestamp'2026-09-25 09:31:00', 110D, 300D), (timestamp'2026-09-25 09:52:00', 110D, 10D) AS x(t, p, v)")
    b = intraday.resample(m, 10).orderBy("ts").collect()
    assert b[0].vwap == 107.5 and (b[0].open, b[0].close, b[0].high, b[0].low) == (100, 110, 111, 99) and b[0].trade_count == 4 and len(b) == 2


def test_clean_ratio(spark):
    v = [0.5002, 1.001, 0.3294, 1.49, 0.9677]
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, r double").select("i", marketcap.clean_ratio("r").alias("c")).orderBy("i").collect()]
    assert got[:4] == pytest.approx([0.5, 1.0, 1 / 3, 1.5]) and got[4] is None


SEC = "corporate_id int, d date, shares double, basis date"


def test_far_counts_confirm_a_split(spark):
    ev = spark.createDataFrame([("CSX", D("2011-06-16"), 1, 3.0), ("X", D("2020-06-01"), 2, 2.0)], "ticker string, date date, corporate_id int, yahoo_factor double")
    sec = spark.createDataFrame([(1, D("2010-09-24"), 1.2e9, D("2010-09-24")), (1, D("2011-07-01"), 3.5125e9, D("2011-07-01")), (2, D("2019-01-01"), 1e6, D("2019-01-01")), (2, D("2021-01-01"), 1.7e6, D("2021-01-01"))], SEC)
    now = spark.createDataFrame([], "corporate_id int, shares double, d date")
    out = rows(marketcap.classify_events(ev, sec, now), "ticker")
    assert out["CSX",].split_factor == 3.0 and not out["CSX",].review and out["X",].split_factor == 1.0 and out["X",].review


def test_restated_count(spark):
    ev = spark.createDataFrame([("GOOGL", D("2014-04-03"), 1, 1.998)], "ticker string, date date, corporate_id int, yahoo_factor double")
    sec = spark.createDataFrame([(1, D("2013-12-31"), 335.832e6, D("2014-02-12")), (1, D("2014-03-31"), 674.462e6, D("2014-04-24"))], SEC)
    r = marketcap.classify_events(ev, sec, spark.createDataFrame([], "corporate_id int, shares double, d date")).first()
    assert (r.split_factor, r.method) == (2.0, "sec_counts")


def test_market_cap_across_a_split(spark):
    px = spark.createDataFrame([("AAPL", D("2020-07-20"), 98.0, 0.0, "USD", 1.0), ("AAPL", D("2020-08-28"), 124.81, 0.0, "USD", 1.0), ("AAPL", D("2020-08-31"), 129.04, 4.0, "USD", 1.0), ("AAPL", D("2020-10-20"), 117.5, 0.0, "USD", 1.0)],
                               "ticker string, date date, close double, stock_splits double, currency string, fx_to_usd double")
    comp = spark.createDataFrame([(1, "AAPL", None)], "corporate_id int, primary_ticker string, yf_shares_outstanding double")
    counts = spark.createDataFrame([(1, D("2020-07-17"), 4.275e9, D("2020-06-27"), D("2020-07-31")), (1, D("2020-10-16"), 17.1e9, D("2020-09-26"), D("2020-10-30"))], "corporate_id int, shares_as_of date, shares_outstanding double, period_end date, filed_date date")
    out = marketcap.run(px, comp, counts, spark.createDataFrame([], "corporate_id int, shares double, d date"))
    caps = rows(out["market_cap"], "date")
    assert caps[D("2020-08-28"),].market_cap == pytest.approx(124.81 * 4 * 4.275e9) and caps[D("2020-08-31"),].market_cap == pytest.approx(129.04 * 4 * 4.275e9)
    assert caps[D("2020-08-28"),].shares_outstanding == pytest.approx(4.275e9) and caps[D("2020-08-31"),].shares_outstanding == pytest.approx(17.1e9)
    assert caps[D("2020-08-28"),].shares_source == "sec_cover_page"


def test_share_glitches_are_dropped(spark):
    v = [3.79e9, 3.75e9, 1.82e9, 3.63e9, 3.6e9]
    ev = spark.createDataFrame([(1, D(f"2023-0{i + 1}-01"), x) for i, x in enumerate(v)], "corporate_id int, d date, shares_today double")
    assert sorted(r.shares_today for r in marketcap.clean_sec_shares(ev).collect()) == sorted(x for x in v if x != 1.82e9)


FACT = "company int, tag string, unit string, start date, end date, val double, accn string, fy int, fp string"


def _company(spark):
    f = []
    add = lambda tag, val, end, start=None, accn="k", fy=2019, fp="FY", unit="USD": f.append((1, tag, unit, D(start) if start else None, D(end), float(val), accn, fy, fp))
    rev, ocf, capex = "RevenueFromContractWithCustomerExcludingAssessedTax", "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"
    add("SalesRevenueNet", 400, "2018-12-31", "2018-01-01", "k18", 2018)
    add(ocf, 60, "2018-12-31", "2018-01-01", "k18", 2018)
    add("SalesRevenueNet", 999, "2018-12-31", "2018-01-01", "k18a", 2018)
    for q, (end, start, r, o) in enumerate((("2019-03-31", "2019-01-01", 100, 10), ("2019-06-30", "2019-04-01", 110, 25), ("2019-09-30", "2019-07-01", 120, 45)), 1):
        add(rev, r, end, start, f"q{q}", 2019, f"Q{q}")
        add(rev, 1, end.replace("2019", "2018"), start.replace("2019", "2018"), f"q{q}", 2019, f"Q{q}")
        add(ocf, o, end, "2019-01-01", f"q{q}", 2019, f"Q{q}")
        add(capex, 2 * q, end, "2019-01-01", f"q{q}", 2019, f"Q{q}")
        add("EarningsPerShareDiluted", 0.5, end, start, f"q{q}", 2019, f"Q{q}", "USD/shares")
        add("CashAndCashEquivalentsAtCarryingValue", 50 + q, end, None, f"q{q}", 2019, f"Q{q}")
    for tag, val, unit in ((rev, 460, "USD"), (ocf, 70, "USD"), (capex, 8, "USD"), ("EarningsPerShareDiluted", 2.1, "USD/shares")):
        add(tag, val, "2020-01-05", "2018-12-31", "k19", 2019, "FY", unit)
    add("CashAndCashEquivalentsAtCarryingValue", 60, "2020-01-05", None, "k19")
    add("Assets", 1000, "2020-01-05", None, "k19")
    add("EntityCommonStockSharesOutstanding", 300, "2020-01-25", None, "k19", unit="shares")
    filings = [(1, "k18", "10-K", D("2019-02-01"), D("2018-12-31")), (1, "k18a", "10-K/A", D("2019-06-01"), D("2018-12-31")), (1, "k19", "10-K", D("2020-02-01"), D("2020-01-05"))]
    filings += [(1, f"q{q}", "10-Q", D(f"2019-{3 * q + 1:02d}-15"), D(e)) for q, e in ((1, "2019-03-31"), (2, "2019-06-30"), (3, "2019-09-30"))]
    return spark.createDataFrame(f, FACT), spark.createDataFrame(filings, "company int, accn string, form string, filed_date date, report_date date")


def test_statements(spark):
    q, y = fu.build(*_company(spark))
    q, y = rows(q, "fy", "fq"), rows(y, "fy")
    assert y[2018,].revenue == 400 and y[2018,].accn == "k18" and y[2019,].revenue == 460
    assert [q[2019, n].revenue for n in (1, 2, 3, 4)] == [100, 110, 120, 130]
    assert [q[2019, n].operating_cash_flow for n in (1, 2, 3, 4)] == [10, 15, 20, 25] and [q[2019, n].capex for n in (1, 2, 3, 4)] == [2, 2, 2, 2]
    assert q[2019, 4].q4_derived and not q[2019, 1].q4_derived
    assert q[2019, 3].eps_diluted == 0.5 and q[2019, 4].eps_diluted is None and y[2019,].eps_diluted == 2.1
    assert y[2019,].period_end == D("2020-01-05") and q[2019, 4].cash == 60 and q[2019, 4].total_assets == 1000
    assert y[2019,].shares_outstanding == 300 and y[2019,].shares_as_of == D("2020-01-25")
    assert y[2019,].free_cash_flow == 62 and y[2018,].free_cash_flow is None and y[2019,].gross_margin is None
