"""Calendars, targets, drifting books with costs, signals, and weight estimators."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio
from tidemark.operators.windows import latest

COST_BPS = 10.0
MOST_NAMES = 20
STEP_MONTHS = {"Monthly": 1, "Quarterly": 3, "Yearly": 12}


def rebalance_dates(calendar: DataFrame, frequency: str, start=None, end=None) -> DataFrame:
    """The first trading day of each period."""
    d = calendar.select("date").distinct()
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    n = STEP_MONTHS[frequency]
    period = F.year("date") * (12 // n) + F.floor((F.month("date") - 1) / n)
    return d.groupBy(period.alias("__p")).agg(F.min("date").alias("date")).select("date")


def top_by_signal(df: DataFrame, by: str, name: str, signal: str, k: int) -> DataFrame:
    return latest(df, by, [F.desc_nulls_last(signal), name], k)


def momentum(panel: DataFrame, long: int = 252, skip: int = 21) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.select("ticker", "date", (ratio(F.lag("close", skip).over(w), F.lag("close", long).over(w)) - 1).alias("signal"))


def mean_reversion(panel: DataFrame, n: int = 21) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.select("ticker", "date", -(ratio(F.col("close"), F.lag("close", n).over(w)) - 1).alias("signal"))


def golden_cross(panel: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """(ticker, date, position, strategy_return): long from the day after the fast mean is above the slow one."""
    w = Window.partitionBy("ticker").orderBy("date")
    mean = lambda n: F.when(F.count("close").over(w.rowsBetween(-(n - 1), 0)) >= n, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
    x = panel.withColumn("__s", F.coalesce((mean(fast) > mean(slow)).cast("int"), F.lit(0))).withColumn("__r", ratio("close", F.lag("close").over(w)) - 1)
    return x.select("ticker", "date", F.coalesce(F.lag("__s").over(w), F.lit(0)).alias("position"), (F.coalesce(F.lag("__s").over(w), F.lit(0)) * F.coalesce("__r", F.lit(0.0))).alias("strategy_return"))


def resolve_targets(targets: DataFrame, dates: DataFrame, priced: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(rebalance, ticker, weight): at each rebalance date the last targets given, of names with a price, the largest `most`, summing to 1."""
    given = targets.select(F.col("date").alias("__given")).distinct()
    from tidemark.operators.joins import asof_join

    d = asof_join(dates.select(F.col("date").alias("rebalance")), given, "rebalance", "__given", inner=True)
    x = d.join(targets.withColumnRenamed("date", "__given"), "__given").where("weight IS NOT NULL AND weight <> 0")
    x = x.join(priced.select("ticker", F.col("date").alias("rebalance")), ["ticker", "rebalance"], "left_semi")
    x = latest(x, "rebalance", [F.desc(F.abs("weight")), "ticker"], most)
    return x.select("rebalance", "ticker", ratio("weight", F.sum("weight").over(Window.partitionBy("rebalance"))).alias("weight"))


def simulate(targets: DataFrame, panel: DataFrame, cost_bps: float = COST_BPS) -> dict[str, DataFrame]:
    """Daily returns, weights and turnover of books that drift between rebalance dates.

    targets: rebalance, ticker, weight. panel: ticker, date, close. Each holding's value is its weight by its growth since
    the rebalance date, so periods don't depend on each other: only costs, which are taken off the day of a trade.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    rets = panel.select("ticker", "date", F.coalesce(ratio("close", F.lag("close").over(w)) - 1, F.lit(0.0)).alias("r"))
    days = panel.select("date").distinct()
    dates = targets.select("rebalance").distinct().withColumn("next", F.lead("rebalance").over(Window.orderBy("rebalance")))
    spans = days.join(F.broadcast(dates), (F.col("date") > F.col("rebalance")) & (F.col("next").isNull() | (F.col("date") <= F.col("next"))))
    held = spans.join(targets.where("weight <> 0"), "rebalance").join(rets, ["ticker", "date"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    run = Window.partitionBy("rebalance", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("value", F.col("weight") * F.product(1 + F.col("r")).over(run))
    book = held.groupBy("rebalance", "date").agg(F.sum("value").alias("pv"))
    book = book.withColumn("gross", F.col("pv") / F.coalesce(F.lag("pv").over(Window.partitionBy("rebalance").orderBy("date")), F.lit(1.0)) - 1)
    weights = held.join(book.select("rebalance", "date", "pv"), ["rebalance", "date"]).select("rebalance", "date", "ticker", (F.col("value") / F.col("pv")).alias("weight"))
    ends = weights.join(dates, "rebalance").where(F.col("date") == F.col("next")).select(F.col("next").alias("rebalance"), "ticker", F.col("weight").alias("drifted"))
    turnover = targets.join(ends, ["rebalance", "ticker"], "full").groupBy("rebalance").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"))
    cost = turnover.select(F.col("rebalance").alias("date"), (F.col("turnover") * cost_bps / 1e4).alias("cost"))
    daily = book.select("date", "gross").unionByName(dates.groupBy().agg(F.min("rebalance").alias("date")).withColumn("gross", F.lit(0.0)))
    daily = daily.join(cost, "date", "left").select("date", F.log1p(F.col("gross") - F.coalesce("cost", F.lit(0.0))).alias("log_return"))
    return {"returns": daily, "weights": weights, "turnover": turnover}


def equal_targets(universe: DataFrame) -> DataFrame:
    """universe: date, ticker."""
    return universe.select("date", "ticker", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def cap_targets(universe: DataFrame) -> DataFrame:
    """universe: date, ticker, market_cap."""
    return universe.select("date", "ticker", ratio("market_cap", F.sum("market_cap").over(Window.partitionBy("date"))).alias("weight"))


def crisis_overlay(targets: DataFrame, regimes: DataFrame, safe: str = "CASH", threshold: float = 0.5, keep: float = 0.0) -> DataFrame:
    """Targets scaled to `keep` where the crisis probability in force is over the threshold, the rest in the safe asset."""
    from tidemark.operators.joins import asof_join

    p = asof_join(targets.select("date").distinct(), regimes.select(F.col("date").alias("__d"), "p_crisis"), "date", "__d")
    k = F.when(F.coalesce(F.col("p_crisis") > threshold, F.lit(False)), F.lit(keep)).otherwise(F.lit(1.0))
    p = p.select("date", k.alias("__k"))
    stocks = targets.join(p, "date").select("date", "ticker", (F.col("weight") * F.col("__k")).alias("weight"))
    return stocks.unionByName(p.where("__k < 1").select("date", F.lit(safe).alias("ticker"), (1 - F.col("__k")).alias("weight")))


def clip_to_box(w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest weights in the box that sum to 1, by shifting all of them alike."""
    lo, hi = float((low - w).min()) - 1, float((high - w).max()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.clip(w + mid, low, high).sum() < 1:
            lo = mid
        else:
            hi = mid
    return np.clip(w + hi, low, high)


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance shrunk to a multiple of the identity, by the Ledoit-Wolf intensity."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, ((x**2).T @ (x**2) / n - s**2).sum() / (n * p)) if d2 > 0 else 0.0
    k = b2 / d2 if d2 > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p)


def min_variance(cov: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Weights of least variance in a box, by projected gradient steps."""
    w = clip_to_box(np.full(len(cov), 1 / len(cov)), low, high)
    step = 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-18)
    for _ in range(rounds):
        new = clip_to_box(w - step * (cov @ w), low, high)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def max_sharpe(mean: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray, points: int = 60) -> np.ndarray:
    """Weights of the largest ratio of mean to deviation along the box-constrained frontier."""
    best, best_ratio = min_variance(cov, low, high), -np.inf
    step0 = 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-18)
    w = best
    for tilt in np.geomspace(1e-3, 1e3, points) * np.sqrt(np.trace(cov) / len(cov)):
        for _ in range(300):
            new = clip_to_box(w - step0 * (cov @ w - tilt * mean), low, high)
            if np.abs(new - w).max() < 1e-10:
                break
            w = new
        r = float(mean @ w) / float(np.sqrt(max(w @ cov @ w, 1e-18)))
        if r > best_ratio:
            best, best_ratio = w.copy(), r
    return best


def ward_order(dist: np.ndarray) -> list[int]:
    """Leaves in the order of a Ward dendrogram, by the Lance-Williams recurrence."""
    n = len(dist)
    size, members, d = {i: 1 for i in range(n)}, {i: [i] for i in range(n)}, {(i, j): float(dist[i, j]) for i in range(n) for j in range(i + 1, n)}
    key = lambda a, b: (a, b) if a < b else (b, a)
    nxt = n
    while len(size) > 1:
        (a, b), dab = min(d.items(), key=lambda x: (x[1], x[0]))
        for c in size:
            if c not in (a, b):
                total = size[a] + size[b] + size[c]
                d2 = ((size[a] + size[c]) * d[key(a, c)] ** 2 + (size[b] + size[c]) * d[key(b, c)] ** 2 - size[c] * dab**2) / total
                d[key(c, nxt)] = max(d2, 0.0) ** 0.5
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        members[nxt], size[nxt] = members.pop(a) + members.pop(b), size.pop(a) + size.pop(b)
        nxt += 1
    return next(iter(members.values()), [])


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: order by correlation distance, then split the weight between halves by inverse variance."""
    sd = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    order, w = ward_order(np.sqrt((1 - corr) / 2)), np.ones(len(cov))

    def variance(ix):
        iv = 1 / np.diag(cov)[ix]
        iv = iv / iv.sum()
        return float(iv @ cov[np.ix_(ix, ix)] @ iv)

    todo = [order]
    while todo:
        ix = todo.pop()
        if len(ix) < 2:
            continue
        a, b = ix[: len(ix) // 2], ix[len(ix) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb) if va + vb > 0 else 0.5
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w


def estimate_targets(rows: DataFrame, method: str = "hrp", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(date, ticker, weight) of each rebalance date from its trailing returns.

    rows: date (of the rebalance), k, ticker, ret. A date's block is a few hundred rows by a few dozen names: one group.
    method: hrp, min_variance, max_sharpe.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="k", columns="ticker", values="ret").sort_index(ascending=False)
        x = x.loc[:, x.notna().mean() >= 0.9].fillna(0.0)
        n = x.shape[1]
        if n == 0 or len(x) < 3:
            return pd.DataFrame({"date": [], "ticker": [], "weight": []})
        cov = shrunk_covariance(x.to_numpy()) + 1e-12 * np.eye(n)
        lo, hi = np.full(n, min(low, 1 / n)), np.full(n, max(high, 1 / n))
        w = min_variance(cov, lo, hi) if method == "min_variance" else max_sharpe(x.mean().to_numpy(), cov, lo, hi) if method == "max_sharpe" else clip_to_box(hrp(cov), lo, hi)
        return pd.DataFrame({"date": pdf["date"].iloc[0], "ticker": x.columns, "weight": w})

    return rows.groupBy("date").applyInPandas(run, "date date, ticker string, weight double")
