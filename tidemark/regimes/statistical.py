"""Statistical regimes, one group a series: changepoints, a hidden Markov model, Wasserstein clusters, and how they are read."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# changepoints -------------------------------------------------------------------------------------------------------
def mood_statistics(x: np.ndarray) -> np.ndarray:
    """Standardised Mood statistic of every split of x: squared distance of the first part's ranks from the middle rank."""
    n = len(x)
    ranks = np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1.0
    d = (ranks - (n + 1) / 2) ** 2
    k = np.arange(1, n)
    mean = k * (n * n - 1) / 12
    var = k * (n - k) * (n + 1) * (n * n - 4) / 180
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs(np.cumsum(d)[:-1] - mean) / np.sqrt(var)


def changepoints(x: np.ndarray, startup: int = 21, threshold: float = 4.6, least: int = 4) -> list[tuple[int, int]]:
    """(detected at, changed at) of a sequential scale-change detector that starts anew after each change.

    threshold takes the place of a table of run-length thresholds: the largest statistic over splits above it is a change.
    """
    out, begin, t = [], 0, 0
    n = len(x)
    while t < n:
        seen = x[begin : t + 1]
        if len(seen) >= startup:
            s = mood_statistics(seen)
            s[: least - 1] = 0
            s[len(s) - least + 1 :] = 0
            k = int(np.argmax(s))
            if s[k] > threshold:
                out.append((t, begin + k + 1))
                begin, t = begin + k + 1, max(t, begin + k + 1)
        t += 1
    return out


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def changepoint_regime(returns: DataFrame, by: str = "series", day: str = "date", r: str = "r", half_life: int = 21, level: float = 0.20, width: float = 0.05, startup: int = 21) -> DataFrame:
    """(by, date, p_crisis): volatility of the current segment against a level, known from the day after a detection on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, ignore_index=True)
        x = pdf[r].to_numpy(float)
        p, state, marks = np.full(len(x), np.nan), np.nan, dict(changepoints(x, startup))
        for t in range(len(x)):
            p[t] = state  # shifted by a day
            if t in marks:
                seg = x[marks[t] : t + 1]
                w = 0.5 ** (np.arange(len(seg))[::-1] / half_life)
                vol = math.sqrt(float((w * seg**2).sum() / w.sum()) * 252)
                state = normal_cdf((vol - level) / width)
        return pd.DataFrame({by: pdf[by], day: pdf[day], "p_crisis": p})

    kinds = dict(returns.dtypes)
    return returns.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {day} {kinds[day]}, p_crisis double")


# hidden Markov model ------------------------------------------------------------------------------------------------
def hmm_filter(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered state probabilities of a Gaussian chain and its log likelihood."""
    p, out, ll = start, np.zeros((len(x), len(mean))), 0.0
    for t, v in enumerate(x):
        like = np.exp(-0.5 * ((v - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        joint = (p if t == 0 else p @ move) * like
        total = joint.sum()
        p = joint / total
        out[t] = p
        ll += math.log(total)
    return out, ll


def hmm_fit(x: np.ndarray, rounds: int = 50) -> dict:
    """Two states by expectation maximisation; state 1 is the one with the larger deviation."""
    mean, sd = np.array([x.mean(), x.mean()]), np.array([0.6, 1.6]) * (x.std() + 1e-12)
    move, start = np.array([[0.98, 0.02], [0.05, 0.95]]), np.array([0.5, 0.5])
    for _ in range(rounds):
        f, _ = hmm_filter(x, mean, sd, move, start)
        like = np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / sd + 1e-300
        b, g, xi = np.ones(2), np.zeros_like(f), np.zeros((2, 2))
        g[-1] = f[-1]
        for t in range(len(x) - 2, -1, -1):
            nxt = like[t + 1] * b
            pair = f[t][:, None] * move * nxt[None, :]
            xi += pair / pair.sum()
            b = move @ nxt
            b /= b.sum()
            g[t] = f[t] * b
            g[t] /= g[t].sum()
        weight = g.sum(axis=0) + 1e-9
        mean = (g * x[:, None]).sum(axis=0) / weight
        sd = np.sqrt((g * (x[:, None] - mean) ** 2).sum(axis=0) / weight) + 1e-9
        move, start = (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True), g[0]
    if sd[0] > sd[1]:
        mean, sd, move, start = mean[::-1], sd[::-1], move[::-1, ::-1], start[::-1]
    return {"mean": mean, "sd": sd, "move": move, "start": start}


def hmm_regime(returns: DataFrame, by: str = "series", day: str = "date", r: str = "r", warmup: int = 250, forget: float = 0.998) -> DataFrame:
    """(by, date, p_calm, p_crisis): filtered probabilities; after a fit on the first rows, moments follow with forgetting."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, ignore_index=True)
        x, p = pdf[r].to_numpy(float), np.full(len(pdf), np.nan)
        if len(x) > 30:
            k = min(warmup, len(x))
            m = hmm_fit(x[:k])
            f, _ = hmm_filter(x[:k], m["mean"], m["sd"], m["move"], m["start"])
            p[:k] = f[:, 1]
            state, mean, var = f[-1], m["mean"].copy(), m["sd"] ** 2
            for t in range(k, len(x)):
                sd = np.sqrt(var)
                like = np.exp(-0.5 * ((x[t] - mean) / sd) ** 2) / sd + 1e-300
                state = (state @ m["move"]) * like
                state /= state.sum()
                step = (1 - forget) * state
                mean = mean + step * (x[t] - mean)
                var = np.maximum(var + step * ((x[t] - mean) ** 2 - var), 1e-12)
                p[t] = state[1]
        return pd.DataFrame({by: pdf[by], day: pdf[day], "p_calm": 1 - p, "p_crisis": p})

    kinds = dict(returns.dtypes)
    return returns.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {day} {kinds[day]}, p_calm double, p_crisis double")


# Wasserstein clusters -----------------------------------------------------------------------------------------------
def windows(df: DataFrame, by: str, day: str, x: str, size: int, step: int) -> DataFrame:
    """(by, i, end, values): sorted values of each window of `size` rows, one every `step` rows."""
    w = Window.partitionBy(by).orderBy(day)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("values", F.array_sort(F.collect_list(x).over(w.rowsBetween(-(size - 1), 0))))
    return rows.where((F.col("__i") >= size) & ((F.col("__i") - size) % step == 0)).select(by, ((F.col("__i") - size) / step).cast("int").alias("i"), F.col(day).alias("end"), "values")


def w_distance(a, b, p: int = 1):
    """Distance of two equally large empirical measures on the line, given sorted: mean of powers of differences."""
    d = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))
    return F.pow(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(a), F.lit(1.0 / p))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The cheapest matching of rows to columns of a square matrix, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def w2_points(a: np.ndarray, b: np.ndarray) -> float:
    """Second Wasserstein distance of two clouds of as many points."""
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return math.sqrt(max(0.0, float(cost[np.arange(len(a)), assignment(cost)].mean())))


def wk_means(values: np.ndarray, k: int = 2, p: int = 1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and barycentres of sorted windows: median (p = 1) or mean (p = 2) of their quantiles; label order by spread."""
    spread = values.std(axis=1)
    seeds = [int(np.argsort(spread)[int(q * (len(values) - 1))]) for q in (np.arange(k) + 0.5) / k]
    centres, labels = values[seeds].copy(), np.zeros(len(values), dtype=int)
    for _ in range(rounds):
        d = (np.abs(values[:, None, :] - centres[None, :, :]) ** p).mean(axis=2)
        new = d.argmin(axis=1)
        if (new == labels).all() and _ > 0:
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                centres[j] = np.median(values[labels == j], axis=0) if p == 1 else values[labels == j].mean(axis=0)
    order = np.argsort(centres.std(axis=1))
    return np.argsort(order)[labels], centres[order]


def k_medoids(dist: np.ndarray, k: int = 2, rounds: int = 50) -> tuple[np.ndarray, list[int]]:
    """Labels and medoids of a distance matrix: the first medoid is the most central point, the others the farthest ones."""
    medoids = [int(dist.sum(axis=1).argmin())]
    while len(medoids) < min(k, len(dist)):
        medoids.append(int(dist[:, medoids].min(axis=1).argmax()))
    labels = dist[:, medoids].argmin(axis=1)
    for _ in range(rounds):
        new = [int(np.flatnonzero(labels == j)[dist[np.ix_(labels == j, labels == j)].sum(axis=1).argmin()]) if (labels == j).any() else medoids[j] for j in range(len(medoids))]
        if new == medoids:
            break
        medoids = new
        labels = dist[:, medoids].argmin(axis=1)
    return labels, medoids


def wasserstein_regime(df: DataFrame, by: str = "series", day: str = "date", x: str = "r", size: int = 35, step: int = 7, k: int = 2, p: int = 1) -> DataFrame:
    """(by, end, label): cluster of each window, 0 the calmest. A series' windows are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        labels, _ = wk_means(np.stack(pdf["values"].to_numpy()), min(k, len(pdf)), p)
        return pd.DataFrame({by: pdf[by], "end": pdf["end"], "label": labels})

    kinds = dict(df.dtypes)
    return windows(df, by, day, x, size, step).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, end {kinds[day]}, label int")


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    at = np.sort(np.concatenate([a, b]))
    return float(np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max())


def jump_diffusion(seed: int, n: int, calm=(0.05, 0.1, 5.0, 0.01, 0.01), crisis=(-0.1, 0.3, 20.0, -0.02, 0.05), switch: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Returns of a Merton process that changes its parameters every `switch` steps, and the true states."""
    rng, dt = np.random.default_rng(seed), 1 / 252
    state = (np.arange(n) // switch) % 2
    drift, vol, rate, jump, jump_sd = np.array([calm, crisis])[state].T
    jumps = rng.poisson(rate * dt)
    return (drift - vol**2 / 2) * dt + vol * math.sqrt(dt) * rng.standard_normal(n) + jumps * jump + np.sqrt(jumps) * jump_sd * rng.standard_normal(n), state


# reading regimes ----------------------------------------------------------------------------------------------------
def smooth_probability(df: DataFrame, by: str, day: str, p: str, half_life: float) -> DataFrame:
    """Exponentially weighted mean of p with a half-life, weights adjusted at the start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        return pdf.assign(**{p: pdf[p].ewm(halflife=half_life).mean()})

    return df.groupBy(by).applyInPandas(run, df.schema)


def in_force(dates: DataFrame, regimes: DataFrame, day: str = "date") -> DataFrame:
    """dates with the probabilities known the day before: regimes move to the next day before they are looked up."""
    from tidemark.operators.joins import asof_join

    known = regimes.withColumn("known", F.date_add(day, 1)).drop(day)
    return asof_join(dates, known, day, "known")


def flips(df: DataFrame, by: str, day: str, label: str) -> DataFrame:
    """(by, year, flips, share): label changes and the share of days under label 1, by year."""
    w = Window.partitionBy(by).orderBy(day)
    x = df.withColumn("__f", (F.col(label) != F.lag(label).over(w)).cast("int"))
    return x.groupBy(by, F.year(day).alias("year")).agg(F.sum(F.coalesce("__f", F.lit(0))).alias("flips"), F.avg((F.col(label) == 1).cast("double")).alias("share"))
