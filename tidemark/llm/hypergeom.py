"""Exact draws without replacement: hypergeometric, multivariate, and splitting trees over many parts."""

import math

import numpy as np

#: numpy's generator is exact below this population; beyond it a rejection sampler with log-gamma takes over.
NUMPY_LIMIT = 1_000_000_000


def generator(*key: int) -> np.random.Generator:
    """A generator that depends on the key alone, so that a task run again draws the same."""
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n taken from good + bad."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    lg = math.lgamma

    def log_p(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(n - k + 1) + lg(bad - n + k + 1))

    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)))
    top, width = log_p(mode), 2.0 * sd + 3.0
    while True:  # ratio of uniforms about the mode
        u, v = 1.0 - rng.random(), rng.random() * 2 - 1
        x = math.floor(mode + 0.5 + width * v / u)
        if lo <= x <= hi and 2 * math.log(u) <= log_p(x) - top:
            return int(x)


def multivariate(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n taken from all: one conditional hypergeometric draw after another."""
    colours = np.asarray(colours, dtype=np.int64)
    total = int(colours.sum())
    if total < NUMPY_LIMIT and len(colours) > 1:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros_like(colours)
    for i, c in enumerate(colours):
        if n <= 0:
            break
        total -= int(c)
        out[i] = hypergeometric(rng, int(c), total, n)
        n -= int(out[i])
    return out


def split_path(colours: np.ndarray, parts: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """The colours that part number `leaf` draws when `parts` (their sizes) share all colours at random.

    The parts are the leaves of a binary tree. Each node splits its colours between its halves by one multivariate
    hypergeometric draw, seeded by the node, so each leaf can be had alone in O(log parts) draws and all leaves agree.
    """
    lo, hi, ends = 0, len(parts), np.concatenate([[0], np.cumsum(parts)])
    colours = np.asarray(colours, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = multivariate(generator(seed, lo, hi), colours, int(ends[mid] - ends[lo]))
        if leaf < mid:
            colours, hi = left, mid
        else:
            colours, lo = colours - left, mid
    return colours


def split_all(colours: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    """All leaves of split_path, a row for each part."""
    out = np.zeros((len(parts), len(colours)), dtype=np.int64)
    ends, todo = np.concatenate([[0], np.cumsum(parts)]), [(0, len(parts), np.asarray(colours, dtype=np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi - lo == 1:
            out[lo] = here
        elif hi > lo:
            mid = (lo + hi) // 2
            left = multivariate(generator(seed, lo, hi), here, int(ends[mid] - ends[lo]))
            todo += [(lo, mid, left), (mid, hi, here - left)]
    return out
