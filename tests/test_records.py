"""Worked examples of the backtest record, the comparison tables and the read functions."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark import backtest, compare, readside


def days(spark, values, name="a"):
    rows = [(name, dt.date(2020, 1, 30) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, v double")


def test_record(spark):
    x = backtest.backtest_record(days(spark, [100.0, 110.0, 99.0, None, 104.5, 121.0, 115.0]), "ticker", "date", "v").first()
    rets = [0.1, -0.1, 104.5 / 99 - 1, 121 / 104.5 - 1, 115 / 121 - 1]
    assert x.n_days == 5 and math.isclose(x.total_return, 0.15) and math.isclose(x.max_drawdown, -0.1)
    assert math.isclose(x.downside_deviation, math.sqrt((rets[1] ** 2 + rets[4] ** 2) / 2 * 252)) and math.isclose(x.recovery_factor, 1.5)
    assert (x.max_dd_duration_days, x.avg_dd_duration_days, x.current_dd_duration_days) == (2, 1.0, 0)
    assert x.best_month_date == dt.date(2020, 1, 31) and math.isclose(x.best_month, 0.1) and math.isclose(x.worst_month, 115 / 110 - 1)
    assert x.best_day_date == dt.date(2020, 2, 4) and x.worst_day_date == dt.date(2020, 2, 1) and (x.max_consecutive_wins, x.max_consecutive_losses) == (2, 1)


def test_record_of_flat_and_empty_series(spark):
    x = backtest.backtest_record(days(spark, [5.0, 5.0]), "ticker", "date", "v").first()
    assert x.total_return == 0 and x.recovery_factor is None and x.sharpe_ratio is None and x.max_dd_duration_days == 0 and x.avg_drawdown is None
    assert backtest.backtest_record(days(spark, []), "ticker", "date", "v").count() == 0


def test_rf_falls_back(spark):
    m = spark.createDataFrame([(dt.date(2020, 1, 1), None, 2.0)], "date date, a double, b double")
    assert math.isclose(backtest.rf_rate(m, ["a", "b"]).first()[0], 0.02) and backtest.rf_rate(m, ["a"]).first()[0] == 0.04


def windows(spark):
    return spark.createDataFrame([("w", dt.date(2020, 1, 29), dt.date(2020, 12, 31))], "label string, start date, end date")


def test_common_ulcer_ends_at_recovery(spark):
    logs = days(spark, [math.log(0.5), math.log(2.0), math.log(1.5), math.log(0.8)])
    assert math.isclose(compare.common_ulcer(logs, windows(spark), "ticker", "date", "v").first().ulcer_common, math.sqrt(0.25 / 5))
    up = days(spark, [math.log(1.5), math.log(0.8)])
    assert compare.common_ulcer(up, windows(spark), "ticker", "date", "v").first().ulcer_common == 0


def test_window_table(spark):
    x = days(spark, [math.log(0.5), math.log(4.0)])
    row = compare.window_table(x, x.select("date", (F.col("v") * 0).alias("b")), windows(spark), "ticker", "date", "v", "b").first()
    assert math.isclose(row.cum_return, 1.0) and math.isclose(row.excess_return, 1.0) and row.capture is None and row.underwater_share == 0.5 and row.recovered


def test_crisis_share_counts_from_the_first_decision(spark):
    d = days(spark, [0.0] * 4).select("ticker", "date")
    decisions = spark.createDataFrame([("a", dt.date(2020, 1, 31), True), ("a", dt.date(2020, 2, 2), False)], "ticker string, decided date, flag boolean")
    assert math.isclose(compare.crisis_share(d, decisions, "ticker", "date", "decided", "flag").first().crisis_share, 2 / 3)


def test_reads(spark):
    f = spark.createDataFrame([(1, dt.date(2020, 1, 1), "10-K", "0-1"), (1, dt.date(2020, 1, 1), "8-K", "0-2"), (1, dt.date(2021, 1, 1), "4", "0-3")], "corporate_id long, filed_date date, form_type string, accession_no string")
    assert [r.accession_no for r in readside.filings(f, 1).collect()] == ["0-2"]
    y = spark.createDataFrame([(1, 2020, dt.date(2020, 12, 31)), (1, 2021, None)], "corporate_id long, fiscal_year int, period_end date")
    assert [r.label for r in readside.financials(y).collect()] == ["FY2020"]
    t = spark.createDataFrame([("a",), ("b",)], "ticker string")
    assert {tuple(r) for r in readside.has_intraday(t, t.where("ticker = 'a'")).collect()} == {("a", True), ("b", False)}
    assert readside.selected(t, None).count() == 2 and readside.selected(t, ["b"]).count() == 1
