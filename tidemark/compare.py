"""Comparing runs: windows against benchmarks, episodes, z-scores, Borda points, weights, Sharpe tests."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list, avg_rank, ratio, zscore
from tidemark.metrics import with_nav


def parse_run(path) -> dict[str, Column]:
    """model, frequency, detector and series of a folder name like model_frequency__detector_series."""
    p = F.regexp_extract(path, r"([^/]+)/?$", 1)
    pattern = r"^([a-z0-9]+)_(monthly|quarterly|yearly)(?:__([a-z0-9]+)_([a-z0-9]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(F.lower(p), pattern, i), F.lit(""))
    return {"model": part(1), "frequency": part(2), "detector": part(3), "series": part(4)}


def baselines(runs: DataFrame) -> DataFrame:
    """runs with the run of the same model and frequency without a detector."""
    b = runs.where("detector IS NULL").select("model", "frequency", F.col("run").alias("baseline"))
    return runs.join(b, ["model", "frequency"], "left")


def improvement(value, base) -> tuple[Column, Column]:
    """Absolute, and relative to the size of the base."""
    return F.col(value) - F.col(base), ratio(F.col(value) - F.col(base), F.abs(F.col(base)))


def borda(values: DataFrame, by: list[str], value: str, higher_better: Column | None = None) -> DataFrame:
    """values with z-score, Borda points (mean rank less one, the better the more) and rank within by."""
    better = F.when(F.lit(True) if higher_better is None else higher_better, F.col(value)).otherwise(-F.col(value))
    x = values.withColumn("__b", better)
    return x.withColumn("z", zscore(value, by)).withColumn("points", avg_rank("__b", by) - 1).withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("__b")))).drop("__b")


def weighted_score(values: DataFrame, weights: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """Mean over periods by weight, renormalised over the periods that a run has."""
    j = values.join(F.broadcast(weights), period).where(F.col(value).isNotNull())
    return j.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias("score"))


def severity_weights(crises: DataFrame, depth: str = "depth") -> DataFrame:
    """Weights of crises by the size of their loss."""
    total = crises.agg(F.sum(F.abs(depth)).alias("__t"))
    return crises.crossJoin(F.broadcast(total)).withColumn("weight", ratio(F.abs(depth), "__t")).drop("__t")


def sensitivity(values: DataFrame, weights: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """Scores with each period left out in turn."""
    out = values.select(F.col(period).alias("left_out")).distinct().join(values, F.col("left_out") != values[period])
    return weighted_score(out, weights, [*by, "left_out"], period, value)


def hit_rates(values: DataFrame, bench: str, run: str, period: str, value: str) -> DataFrame:
    """(run, wins, n, rate): share of periods in which a run beats the benchmark run."""
    b = values.where(F.col(run) == bench).select(period, F.col(value).alias("__b"))
    j = values.where(F.col(run) != bench).join(b, period).where(F.col(value).isNotNull() & F.col("__b").isNotNull())
    return j.groupBy(run).agg(F.count_if(F.col(value) > F.col("__b")).alias("wins"), F.count("*").alias("n")).withColumn("rate", ratio("wins", "n")).withColumn("label", F.concat(F.col("wins").cast("string"), F.lit("/"), F.col("n").cast("string")))


def episode(df: DataFrame, windows: DataFrame, by, day: str, r: str) -> DataFrame:
    """(by, label, trough, depth, recovery, days, censored): a run's own way through each window (label, start, end).

    Levels start at 1 on the window's start; recovery is the first later day back at it, missing (censored) if there is none.
    """
    by = _list(by)
    j = df.join(F.broadcast(windows), (F.col(day) > F.col("start")) & (F.col(day) <= F.col("end")))
    d = with_nav(j, [*by, "label"], day, r)
    low = d.groupBy(*by, "label").agg(F.min_by(day, F.struct("nav", day)).alias("trough"), (F.min("nav") - 1).alias("depth"), F.min("start").alias("start"), F.max(day).alias("__last"))
    back = d.join(low.select(*by, "label", "trough"), [*by, "label"]).where((F.col(day) > F.col("trough")) & (F.col("nav") >= 1)).groupBy(*by, "label").agg(F.min(day).alias("recovery"))
    out = low.join(back, [*by, "label"], "left")
    return out.withColumn("censored", F.col("recovery").isNull()).withColumn("days", F.datediff(F.coalesce("recovery", "__last"), "start")).withColumn("at_boundary", F.col("trough") == F.col("__last")).drop("__last", "start")


def faster(days_a, censored_a, days_b, censored_b) -> Column:
    """Whether a recovered sooner than b; unknown if a censored time is the shorter."""
    return F.when(~F.col(censored_a) & F.col(censored_b), F.when(F.col(days_a) <= F.col(days_b), F.lit(True))).when(F.col(censored_a) & ~F.col(censored_b), F.when(F.col(days_b) <= F.col(days_a), F.lit(False))).when(~F.col(censored_a) & ~F.col(censored_b), F.col(days_a) < F.col(days_b))


def sharpe_test(a: DataFrame, b: DataFrame, day: str, x: str, y: str, lags: int | None = None) -> DataFrame:
    """(n, sharpe_a, sharpe_b, difference, z, p): difference of two Sharpe ratios by the delta method with Bartlett weights.

    The four moments' deviations and their lagged products are aggregates; what remains are a dozen numbers.
    """
    j = a.select(day, F.col(x).alias("a")).join(b.select(day, F.col(y).alias("b")), day)
    m = j.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(F.col("a") * F.col("a")).alias("qa"), F.avg(F.col("b") * F.col("b")).alias("qb"), F.count("*").alias("n")).first()
    n = int(m["n"])
    k = lags if lags is not None else max(1, int(4 * (max(n, 1) / 100) ** (2 / 9)))
    va, vb = m["qa"] - m["ma"] ** 2, m["qb"] - m["mb"] ** 2
    grad = (m["qa"] / va**1.5, -m["qb"] / vb**1.5, -0.5 * m["ma"] / va**1.5, 0.5 * m["mb"] / vb**1.5)
    u = grad[0] * (F.col("a") - m["ma"]) + grad[1] * (F.col("b") - m["mb"]) + grad[2] * (F.col("a") * F.col("a") - m["qa"]) + grad[3] * (F.col("b") * F.col("b") - m["qb"])
    e = j.withColumn("u", u)
    w = Window.orderBy(day)  # one pair of series
    for i in range(1, k + 1):
        e = e.withColumn(f"p{i}", F.col("u") * F.lag("u", i).over(w))
    total = F.sum(F.col("u") * F.col("u"))
    for i in range(1, k + 1):
        total = total + 2 * (1 - i / (k + 1)) * F.coalesce(F.sum(f"p{i}"), F.lit(0.0))
    sa, sb = m["ma"] / math.sqrt(va), m["mb"] / math.sqrt(vb)
    out = e.agg((total / F.count("u")).alias("lrv"), F.count("u").alias("n"))
    out = out.withColumn("sharpe_a", F.lit(sa)).withColumn("sharpe_b", F.lit(sb)).withColumn("difference", F.lit(sa - sb))
    out = out.withColumn("z", ratio("difference", F.sqrt(F.col("lrv") / F.col("n"))))
    # two-sided p by the complementary error function's rational approximation
    t = 1 / (1 + 0.3275911 * F.abs("z") / math.sqrt(2))
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-F.col("z") * F.col("z") / 2)
    return out.select("n", "sharpe_a", "sharpe_b", "difference", "z", erfc.alias("p"))


def timing(run: DataFrame, asset: DataFrame, safe: DataFrame, day: str) -> DataFrame:
    """(share, run_mean, mix_mean, timing): a switching run against a static mix with its average share in the safe asset."""
    j = run.select(day, "r", "in_crisis").join(asset.select(day, F.col("r").alias("a")), day).join(safe.select(day, F.col("r").alias("s")), day)
    g = j.agg(F.avg(F.col("in_crisis").cast("double")).alias("share"), F.avg("r").alias("run_mean"), F.avg("a").alias("__a"), F.avg("s").alias("__s"))
    mix = (1 - F.col("share")) * F.col("__a") + F.col("share") * F.col("__s")
    return g.select("share", "run_mean", mix.alias("mix_mean"), (F.col("run_mean") - mix).alias("timing"))


def window_table(df: DataFrame, bench: DataFrame, windows: DataFrame, by, order: str, r: str, b: str, keys=("label",), f: int = 252) -> DataFrame:
    """(by, keys, ...): each run in each window (start, end] against the benchmark's log returns b of the same days.

    Excess is end value against end value, capture the ratio of the two returns (null where the benchmark's is zero). Levels
    start at 1, which counts as the first peak; recovered: the last level is at it again. windows is a short list of episodes.
    """
    by, keys = _list(by), _list(list(keys))
    inside = (F.col(order) > F.col("start")) & (F.col(order) <= F.col("end"))
    d = with_nav(df.join(F.broadcast(windows), inside), [*by, *keys], order, r)
    g = d.groupBy(*by, *keys).agg(
        F.count(r).alias("n"), (F.exp(F.sum(r)) - 1).alias("cum_return"), F.min("drawdown").alias("max_dd"),
        F.sqrt(F.sum(F.col("drawdown") * F.col("drawdown")) / (F.count("*") + 1)).alias("ulcer"), (F.stddev_samp(r) * math.sqrt(f)).alias("ann_vol"),
        F.avg((F.col("drawdown") < -1e-12).cast("double")).alias("underwater_share"), (F.max_by("nav", order) >= 1 - 1e-12).alias("recovered"))
    base = bench.join(F.broadcast(windows), inside).groupBy(*keys).agg((F.exp(F.sum(b)) - 1).alias("bench_return"))
    out = g.join(base, keys, "left")
    return out.withColumn("excess_return", ratio(1 + F.col("cum_return"), 1 + F.col("bench_return")) - 1).withColumn("capture", ratio("cum_return", "bench_return"))


def phase_table(df: DataFrame, bench: DataFrame, crises: DataFrame, by, order: str, r: str, b: str) -> DataFrame:
    """One row for each run and crisis (label, peak, trough, even): ptt_* from peak to trough, ttp_* from there to recovery."""
    by = _list(by)
    phase = lambda name, start, end: F.struct(F.lit(name).alias("phase"), F.col(start).alias("start"), F.col(end).alias("end"))
    windows = crises.select("label", F.inline(F.array(phase("ptt", "peak", "trough"), phase("ttp", "trough", "even"))))
    t = window_table(df, bench, windows, by, order, r, b, ("label", "phase"))
    at = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{c}")
    return t.groupBy(*by, "label").agg(*[at(p, c) for p in ("ptt", "ttp") for c in ("cum_return", "excess_return", "capture", "max_dd")])


def common_ulcer(df: DataFrame, windows: DataFrame, by, order: str, r: str) -> DataFrame:
    """(by, label, ulcer_common): drawdowns up to a run's own recovery and zero after it, over all days of the window.

    A run that never falls below its start has zero. So a longer recovery raises the value and all runs have as many days.
    """
    by = _list(by)
    inside = (F.col(order) > F.col("start")) & (F.col(order) <= F.col("end"))
    d = with_nav(df.join(F.broadcast(windows), inside), [*by, "label"], order, r)
    w = Window.partitionBy(*by, "label")
    d = d.withColumn("__low", F.min(F.struct("nav", F.col(order).alias("day"))).over(w))
    d = d.withColumn("__back", F.min(F.when((F.col(order) > F.col("__low.day")) & (F.col("nav") >= 1), F.col(order))).over(w))
    own = (F.col("__low.nav") < 1) & (F.col("__back").isNull() | (F.col(order) <= F.col("__back")))
    depth = F.when(own, F.col("drawdown")).otherwise(0.0)
    return d.groupBy(*by, "label").agg(F.sqrt(F.sum(depth * depth) / (F.count("*") + 1)).alias("ulcer_common"))


def crisis_share(days: DataFrame, decisions: DataFrame, by, day: str, decided: str, flag: str) -> DataFrame:
    """(by, crisis_share): the share of days on which the last decision says crisis; days before the first one don't count."""
    from tidemark.operators.joins import asof_join

    by = _list(by)
    j = asof_join(days, decisions, day, decided, by)
    return j.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias("crisis_share"))


def value_table(values: DataFrame, metric: str, period: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """(metric, period, a column for each run): one block for each metric, of the runs of the configured list."""
    return values.groupBy(metric, period).pivot(run, runs).agg(F.first(value))
