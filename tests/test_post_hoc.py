"""Contrasts, resampled serial correlation, normality and densities against plain versions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions.distributions import f_upper
from termloom.functions.multivariate_t import f_uppers, single_step
from termloom.functions.normal import normal_quantile, normal_quantiles
from termloom.operators import linear_models, statistics


def tukey(levels):
    rows = []
    for i in range(levels):
        for j in range(i + 1, levels):
            row = np.zeros(levels)
            row[i], row[j] = -1, 1
            rows.append(row / math.sqrt(2))
    return np.array(rows)


@pytest.mark.parametrize(
    "levels, dof, range_, p",  # tabulated points of the studentised range
    [(2, 10, 3.151, 0.05), (3, 10, 3.877, 0.05), (3, 20, 4.640, 0.01), (5, 20, 4.232, 0.05), (10, 60, 4.646, 0.05)],
)
def test_single_step_p_values_are_those_of_the_tables(levels, dof, range_, p):
    rows = tukey(levels)
    found = single_step(np.full(len(rows), range_ / math.sqrt(2)), rows @ rows.T, dof)
    assert np.allclose(found, p, atol=0.01 * p)


def test_single_step_of_one_contrast_and_of_equal_ones():
    assert single_step(np.array([2.0]), np.ones((1, 1)), 7)[0] == pytest.approx(f_upper(4.0, 1, 7))
    assert single_step(np.array([2.0, -2.0]), np.array([[1.0, -1], [-1, 1]]), 7) == pytest.approx([f_upper(4.0, 1, 7)] * 2)
    for a in (1, 2, 5):
        for b in (3, 20, 5000):
            x = np.array([0, 0.1, 1, 3, 50.0])
            assert f_uppers(x, a, b) == pytest.approx([f_upper(v, a, b) for v in x], abs=1e-12)


def data(seed=3, n=400):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        g, a = draw.choice("pqr"), draw.randrange(2)
        out.append((i, g, a, {"p": 0.0, "q": 0.3, "r": 1.0}[g] + a * (0.5 if g == "q" else 0.1) + draw.gauss(0, 1)))
    return out


@pytest.fixture(scope="module")
def rows(frame):
    return frame(data(), "i int, g string, a int, y double")


@pytest.mark.parametrize("contrasts, average", [({}, False), ({"a": "sum"}, False), ({}, True)])
def test_model_contrasts_by_cell_means(rows, contrasts, average):
    found = {
        (r.group_a, r.group_b): r
        for r in linear_models.model_contrasts(rows, "y", ["g", "a"], "g", contrasts=contrasts, average=average).collect()
    }
    cells = {}
    for _, g, a, y in data():
        cells.setdefault((g, a), []).append(y)
    rest = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in cells.values())
    dof = len(data()) - len(cells)
    over = [0, 1] if contrasts or average else [0]
    assert set(found) == {("p", "q"), ("p", "r"), ("q", "r")}
    for (x, z), r in found.items():
        difference = np.mean([np.mean(cells[z, a]) - np.mean(cells[x, a]) for a in over])
        share = sum(1 / len(cells[g, a]) for g in (x, z) for a in over) / len(over) ** 2
        assert r.difference == pytest.approx(difference)
        assert r.std_error == pytest.approx(math.sqrt(rest / dof * share))
        assert r.p_value == pytest.approx(f_upper(r.t_value**2, 1, dof))
        assert r.p_value <= r.p_adjusted <= min(1, 3 * r.p_value) + 1e-9


def test_adjusted_p_values_against_simulation(rows):
    found = linear_models.model_contrasts(rows, "y", ["g"], "g").collect()
    counts = {g: sum(x == g for _, x, *_ in data()) for g in "pqr"}
    random_ = np.random.default_rng(1)
    means = {g: random_.normal(size=200_000) / math.sqrt(counts[g]) for g in "pqr"}
    s = np.sqrt(random_.chisquare(len(data()) - 3, 200_000) / (len(data()) - 3))
    largest = np.max([
        np.abs(means[r.group_b] - means[r.group_a]) / math.sqrt(1 / counts[r.group_a] + 1 / counts[r.group_b]) / s
        for r in found], axis=0)
    for r in found:
        assert r.p_adjusted == pytest.approx((largest >= abs(r.t_value)).mean(), abs=0.004)


def test_contrasts_of_one_level_and_coefficients_have_p_values(frame, rows):
    one = frame([(1, "p", 0, 1.0), (2, "p", 1, 2.0), (3, "p", 1, 2.5)], "i int, g string, a int, y double")
    assert linear_models.model_contrasts(one, "y", ["g"], "g").count() == 0
    fit = linear_models.glm_fit(rows, "y", ["g"]).collect()
    assert all(r.p_value == pytest.approx(f_upper(r.t_value**2, 1, len(data()) - 3)) for r in fit)


# Serial correlation ------------------------------------------------------------------------------


def plain_test(rows, replicates, seed):
    """Resampling with numpy: new responses, new cell means, the statistic."""
    g = np.array([r[1] for r in rows])
    y = np.array([r[3] for r in rows])
    names = sorted(set(g))
    code = np.searchsorted(names, g)

    def fitted(v):
        return (np.bincount(code, v) / np.bincount(code))[code]

    e = y - fitted(y)
    statistic = ((e[1:] - e[:-1]) ** 2).sum() / (e @ e)
    random_ = np.random.default_rng(seed)
    below = 0
    for _ in range(replicates):
        v = random_.choice(e, len(e))
        v = v - fitted(v)
        below += ((v[1:] - v[:-1]) ** 2).sum() / (v @ v) < statistic
    return statistic, 2 * min(below / replicates, 1 - below / replicates)


@pytest.mark.parametrize("drift", [0.0, 0.06, 0.2])
def test_resampled_p_value(frame, drift):
    draw = random.Random(5)
    out, last = [], 0.0
    for i in range(600):
        last = drift * last + draw.gauss(0, 1)
        out.append((i, draw.choice("abcd"), 0, last))
    rows = frame(out, "i int, g string, a int, y double")
    found = statistics.durbin_watson_test(rows.repartition(5, "y"), "y", ["g"], ["i"], replicates=800).first()
    statistic, p_value = plain_test(out, 4000, 1)
    assert found.statistic == pytest.approx(statistic)
    spread = math.sqrt(p_value * (1 - p_value) / 800 + 1e-6)
    assert abs(found.p_value - p_value) < 5 * spread + 0.01
    again = statistics.durbin_watson_test(rows.repartition(3), "y", ["g"], ["i"], replicates=800).first()
    assert again.p_value == found.p_value
    short = statistics.durbin_watson_test(rows, "y", ["g"], ["i"], replicates=800, table_size=100).first()
    assert abs(short.p_value - p_value) < 5 * spread + 0.02


def test_serial_correlation_without_rows_or_spread(frame):
    empty = frame([], "i int, g string, y double")
    assert statistics.durbin_watson_test(empty, "y", ["g"], ["i"]).collect() == []
    flat = frame([(1, "a", 2.0), (2, None, 2.0), (3, "a", None)], "i int, g string, y double")
    assert statistics.durbin_watson_test(flat, "y", ["g"], ["i"], replicates=9).first().p_value is None


# Normality and density ----------------------------------------------------------------------------


def test_normal_quantiles(frame):
    ps = [1e-300, 1e-20, 1e-5, 0.01, 0.2, 0.5, 0.7, 0.93, 0.999, 1 - 1e-12]
    expect = [NormalDist().inv_cdf(p) for p in ps]
    assert normal_quantiles(np.array(ps)) == pytest.approx(expect)
    df = frame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got[:-3] == pytest.approx(expect) and got[-3:] == [None] * 3


def test_normality_and_points(frame):
    draw = random.Random(1)
    for make, normal in ((lambda: draw.gauss(3, 2), True), (lambda: draw.random() ** 3, False)):
        values = [make() for _ in range(500)]
        df = frame([(v,) for v in values] + [(None,), (float("nan"),)], "e double").repartition(4)
        found = statistics.normality(df, "e").first()
        m = np.array([NormalDist().inv_cdf((i - 0.375) / 500.25) for i in range(1, 501)])
        assert found.n == 500 and found.statistic == pytest.approx(np.corrcoef(sorted(values), m)[0, 1] ** 2)
        assert (found.p_value > 0.01) == normal
        points = {r.point: r for r in statistics.quantile_points(df, "e", 10).collect()}
        assert {k: r.sample for k, r in points.items()} == {
            k: sorted(values)[math.ceil((k - 0.5) / 10 * 500) - 1] for k in range(1, 11)
        }
        assert points[3].theoretical == pytest.approx(NormalDist().inv_cdf(0.25))
    assert statistics.normality(frame([(1.0,)] * 6, "e double"), "e").first().statistic is None
    assert statistics.quantile_points(frame([], "e double"), "e").collect() == []


def test_density_is_that_of_the_direct_sum(frame):
    draw = random.Random(2)
    groups = {"a": [draw.gauss(0.4, 0.1) for _ in range(300)], None: [draw.random() for _ in range(80)], "one": [0.5] * 4}
    df = frame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    found = {}
    for r in statistics.density(df, ["g"], "v", low=0.0, high=1.0).collect():
        found.setdefault(r.g, []).append((r.x, r.density))
    assert set(found) == set(groups)
    for g, vs in groups.items():
        q1, q3 = np.percentile(vs, [25, 75])
        spread = [s for s in (min(np.std(vs, ddof=1), (q3 - q1) / 1.34), min(vs)) if s > 0][0]
        width = 0.9 * spread * len(vs) ** -0.2
        xs, ds = zip(*sorted(found[g]), strict=True)
        assert xs == pytest.approx(np.linspace(0, 1, 512))
        direct = [np.exp(-(((x - np.array(vs)) / width) ** 2) / 2).sum() / (len(vs) * width * math.sqrt(2 * math.pi)) for x in xs]
        assert np.abs(np.array(ds) - direct).max() < 2e-3 * max(direct)
    assert statistics.density(frame([], "g string, v double"), ["g"], "v").collect() == []


def test_replicates_are_drawn_by_tasks_of_bounded_rows_in_one_job(frame, monkeypatch):
    random = np.random.default_rng(8)
    rows = frame([(i, "ab"[i % 2], float(x)) for i, x in enumerate(random.normal(size=230))], "i int, g string, y double")
    run = lambda: statistics.durbin_watson_test(rows, "y", ["g"], ["i"], replicates=50).first()
    whole, written, write = run(), {}, statistics.materialize

    def kept(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(statistics, "materialize", kept)
    monkeypatch.setattr(statistics, "REPLICATE_ROWS", 50, raising=False)
    cut = run()
    assert written["replicate-sums"].count() == 5  # 230 rows, 50 a task
    assert np.allclose(tuple(cut), tuple(whole))
