"""Numeric kernels: invariants, brute force, and recovery of what was simulated."""

import itertools

import numpy as np
import pytest

from tidemark import indicators, portfolio
from tidemark.regimes import statistical as st


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        c = rng.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        a = st.assignment(c)
        assert sorted(a) == list(range(n)) and c[np.arange(n), a].sum() == pytest.approx(best)


def test_w2_is_a_distance():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(8, 2)), rng.normal(size=(8, 2)) + 3
    assert st.w2_points(a, a) == 0 and st.w2_points(a, b) == pytest.approx(st.w2_points(b, a)) and st.w2_points(a, a + [1, 0]) == pytest.approx(1)


def test_clusters_find_simulated_regimes():
    x, state = st.jump_diffusion(3, 2000)
    size, step = 50, 25
    starts = np.arange(0, len(x) - size + 1, step)
    windows = np.sort(np.stack([x[s : s + size] for s in starts]), axis=1)
    truth = np.array([round(state[s : s + size].mean()) for s in starts])
    labels, centres = st.wk_means(windows, 2, 1)
    assert (labels == truth).mean() > 0.85 and centres[0].std() < centres[1].std()
    d = np.abs(windows[:, None, :] - windows[None, :, :]).mean(axis=2)
    m, medoids = st.k_medoids(d, 2)
    assert len(medoids) == 2 and max((m == truth).mean(), (m != truth).mean()) > 0.75


def test_hmm_separates_volatilities():
    rng = np.random.default_rng(2)
    state = np.repeat([0, 1, 0, 1], 250)
    x = rng.normal(size=1000) * np.array([0.005, 0.03])[state]
    m = st.hmm_fit(x)
    f, _ = st.hmm_filter(x, m["mean"], m["sd"], m["move"], m["start"])
    assert f.sum(axis=1) == pytest.approx(np.ones(1000)) and ((f[:, 1] > 0.5) == state).mean() > 0.9
    assert m["sd"] == pytest.approx([0.005, 0.03], rel=0.25)


def test_changepoint_is_found_after_it_happens():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=200) * 0.01, rng.normal(size=100) * 0.05])
    found = [c for c in st.changepoints(x) if c[1] > 150]
    assert found and found[0][0] > found[0][1] and abs(found[0][1] - 200) < 25


def test_weights():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.01
    cov = portfolio.shrunk_covariance(x)
    assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov)[0] > 0
    lo, hi = np.zeros(6), np.full(6, 0.4)
    w = portfolio.min_variance(cov, lo, hi)
    assert w.sum() == pytest.approx(1) and (w >= -1e-9).all() and (w <= 0.4 + 1e-9).all()
    assert all(w @ cov @ w <= v @ cov @ v + 1e-9 for v in (portfolio.clip_to_box(rng.random(6), lo, hi) for _ in range(200)))
    mean = rng.normal(size=6) * 0.001 + 0.001
    s = portfolio.max_sharpe(mean, cov, lo, hi)
    score = lambda v: mean @ v / np.sqrt(v @ cov @ v)
    assert s.sum() == pytest.approx(1) and score(s) >= score(w) - 1e-9
    h = portfolio.hrp(cov)
    assert h.sum() == pytest.approx(1) and (h > 0).all()
    assert sorted(portfolio.ward_order(rng.random((7, 7)) + 1)) == list(range(7))


def test_equal_assets_get_equal_weights():
    assert portfolio.hrp(np.eye(4)) == pytest.approx([0.25] * 4)
    assert portfolio.min_variance(np.eye(4), np.zeros(4), np.ones(4)) == pytest.approx([0.25] * 4)


def test_parabolic_stop_flips():
    up = np.arange(1.0, 30)
    high, low = np.r_[up, up[::-1]] + 0.5, np.r_[up, up[::-1]] - 0.5
    s = indicators._psar(high, low)
    assert (s[2:28] < low[2:28]).all() and (s[45:] > high[45:]).all()
