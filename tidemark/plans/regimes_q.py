"""Regime queries on the driver's tables."""

from pyspark.sql import functions as F

from tidemark.plans.base import DENSE, dense, query, r, returns
from tidemark.regimes import rules, statistical


@query(f"""WITH {DENSE}, m AS (SELECT ticker, date, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT CASE WHEN ticker IN ('S0', 'S1', 'S2', 'S3') THEN 'east' ELSE 'west' END AS continent, date, count(ma)::BIGINT AS n_available, count(*) FILTER (WHERE close > ma)::BIGINT AS n_above, CASE WHEN count(ma) >= 3 THEN round(count(*) FILTER (WHERE close > ma) / count(ma), 6) END AS breadth FROM m GROUP BY 1, 2""", dates="date")
def breadth_regime(t):
    p = dense(t).withColumn("market", F.lit("m")).withColumn("continent", F.when(F.col("ticker").isin("S0", "S1", "S2", "S3"), "east").otherwise("west"))
    return rules.breadth(p, "continent", 20, 3).select("continent", "date", "n_available", "n_above", r("breadth").alias("breadth"))


_HYST = """WITH RECURSIVE d AS (SELECT event_type AS market, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM d),
h AS (SELECT market, date, i, CASE WHEN v >= 52 THEN 2 WHEN v <= 48 THEN 0 ELSE 1 END AS s FROM n WHERE i = 1 UNION ALL
 SELECT n.market, n.date, n.i, CASE WHEN s = 2 THEN CASE WHEN v <= 48 THEN 0 WHEN v < 50 THEN 1 ELSE 2 END WHEN s = 0 THEN CASE WHEN v >= 52 THEN 2 WHEN v > 50 THEN 1 ELSE 0 END ELSE CASE WHEN v >= 52 THEN 2 WHEN v <= 48 THEN 0 ELSE 1 END END FROM h JOIN n ON n.market = h.market AND n.i = h.i + 1)
SELECT market, date, s AS state FROM h"""


@query(_HYST, dates="date")
def hysteresis(t):
    d = t.events.groupBy(F.col("event_type").alias("market"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    s = rules.Series(d)
    s.hysteresis("v", 52.0, 48.0, 50.0, 50.0, out="state")
    return s.df.select("market", "date", "state")


@query(f"""WITH h AS ({_HYST}), c AS (SELECT market, date, CASE WHEN count(*) OVER w = 5 AND len(list_filter(list(state) OVER w, lambda x: x = state)) >= 3 THEN state END AS c FROM h WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT market, date, last_value(c IGNORE NULLS) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS confirmed FROM c""", dates="date")
def confirmation(t):
    d = t.events.groupBy(F.col("event_type").alias("market"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    s = rules.Series(d)
    s.hysteresis("v", 52.0, 48.0, 50.0, 50.0, out="state")
    s.confirm("state", 5, 3)
    return s.df.select("market", "date", "confirmed")


def _as(t, names):
    """The whole line items as daily closes of a rule set's tickers: the bars of as many groups of suppliers as it has."""
    names = list(names)
    e = F.element_at(F.array(*[F.lit(n) for n in names]), (F.substring("ticker", 2, 9).cast("int") + 1))
    return dense(t, len(names)).select(F.lit("m").alias("market"), "date", e.alias("ticker"), "close")


def _dated(df, *cols):
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *cols)


@query()
def equity_regime(t):
    p = dense(t).withColumn("market", F.lit("m")).withColumn("continent", F.when(F.col("ticker").isin("S0", "S1", "S2", "S3"), "east").otherwise("west"))
    return _dated(rules.equity_regime(p, ma=20, least=3)[1], "global_regime", r("mean_breadth").alias("mean_breadth"))


@query()
def bond_regime(t):
    return _dated(rules.bond_regime(_as(t, rules.BONDS)), "curve_regime", "policy_direction", r("score_smooth").alias("score_smooth"), "bond_regime")


@query()
def forex_regime(t):
    return _dated(rules.forex_regime(_as(t, [*rules.FOREX, *rules.EMERGING])), "usd_regime", "carry_regime", "jpy_regime", "europe_regime", "em_regime", "forex_regime")


@query()
def commodity_regime(t):
    return _dated(rules.commodity_regime(_as(t, rules.COMMODITIES)), r("score_smooth").alias("score_smooth"), "commodity_regime")


@query()
def crypto_regime(t):
    return _dated(rules.crypto_regime(_as(t, rules.CRYPTO)), r("score_smooth").alias("score_smooth"), "crypto_regime")


@query()
def hmm_regime(t):
    return _dated(statistical.hmm_regime(returns(t), "ticker", warmup=60), "ticker", r("p_crisis", 4).alias("p_crisis"))


@query()
def changepoint_regime(t):
    return _dated(statistical.changepoint_regime(returns(t), "ticker", level=0.5, width=0.2), "ticker", r("p_crisis", 4).alias("p_crisis"))


@query()
def wasserstein_regime(t):
    return statistical.wasserstein_regime(returns(t), "ticker", size=12, step=3).select("ticker", F.date_format("end", "yyyy-MM-dd").alias("end"), "label")


@query("""WITH e AS (SELECT vec_id, label, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings), u AS (SELECT vec_id, label, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM e), c AS (SELECT label, i, avg(x) AS c FROM u GROUP BY 1, 2)
SELECT vec_id, u.label, round(avg(abs(x - c)), 6) AS w1, round(sqrt(avg(power(x - c, 2))), 6) AS w2 FROM u JOIN c ON u.label = c.label AND u.i = c.i GROUP BY 1, 2""")
def w_to_barycentre(t):
    """Distance of each vector's values to the mean quantiles of its label."""
    e = t.embeddings.select("vec_id", "label", F.array_sort(F.col("embedding").cast("array<double>")).alias("s"))
    c = e.select("label", F.posexplode("s").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda z: z["c"]).alias("c"))
    d = e.join(c, "label")
    return d.select("vec_id", "label", r(statistical.w_distance(F.col("s"), F.col("c"))).alias("w1"), r(statistical.w_distance(F.col("s"), F.col("c"), 2)).alias("w2"))


@query()
def medoids(t):
    """Labels grouped by the second Wasserstein distance of their mean vectors, read as clouds of points."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label", ignore_index=True)
        clouds = [np.asarray(v, float).reshape(-1, 8) for v in pdf["mean"]]
        d = np.array([[statistical.w2_points(a, b) for b in clouds] for a in clouds])
        labels, _ = statistical.k_medoids(d, 3)
        return pd.DataFrame({"label": pdf["label"], "cluster": labels})

    m = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    m = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("mean"))
    return m.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "label int, cluster int")
