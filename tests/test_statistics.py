import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import ChiSquareTest
from pyspark.ml.feature import StringIndexer, VectorAssembler

from termloom.functions.distributions import chi2_upper, f_upper
from termloom.operators import linear_models as lm
from termloom.operators import statistics as st


@pytest.fixture(scope="module")
def rows(frame):
    random = np.random.default_rng(8)
    data = []
    for i in range(400):
        m, a = f"m{i % 3}", int(random.random() < 0.3 + 0.2 * (i % 3))
        data.append((i, m, a, "AB"[int(random.random() < 0.4)],
                     float(0.5 + 0.1 * (i % 3) + 0.2 * a + random.normal() * 0.1)))
    return frame(data, "i int, model string, accurate int, grp string, y double").cache()


def test_upper_tails_match_tables():
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert f_upper(3.478049690765229, 4, 10) == pytest.approx(0.05, rel=1e-7)
    assert f_upper(0.0, 2, 3) == 1.0 and chi2_upper(0.0, 2) == 1.0


def test_chi_square_matches_ml(rows):
    mine = st.chi_square(rows, "model", "accurate").first()
    indexed = StringIndexer(inputCol="model", outputCol="x").fit(rows).transform(rows)
    assembled = VectorAssembler(inputCols=["x"], outputCol="f").transform(indexed)
    theirs = ChiSquareTest.test(assembled, "f", "accurate").first()
    assert mine.statistic == pytest.approx(theirs.statistics[0])
    assert mine.dof == theirs.degreesOfFreedom[0]
    assert mine.p_value == pytest.approx(theirs.pValues[0])


def test_chi_square_counts_empty_cells(frame):
    df = frame([("a", "x")] * 3 + [("b", "y")] * 2 + [("a", "z")], "a string, b string")
    o = np.array([[3, 0, 1], [0, 2, 0]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert st.chi_square(df, "a", "b").first().statistic == pytest.approx(((o - e) ** 2 / e).sum())


def test_contingency_fills_zero(frame):
    df = frame([("a", 1), ("a", 1), ("b", 0)], "m string, x int")
    out = {r.m: (r["1"], r["0"]) for r in st.contingency(df, "m", "x", [1, 0]).collect()}
    assert out == {"a": (2, 0), "b": (0, 1)}


def grouped(rows, *names):
    groups = {}
    for r in rows.collect():
        groups.setdefault(tuple(r[n] for n in names), []).append(r.y)
    return groups


def oneway(groups):
    values = np.concatenate([np.array(g) for g in groups])
    between = sum(len(g) * (np.mean(g) - values.mean()) ** 2 for g in groups)
    within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
    k, n = len(groups), len(values)
    return (between / (k - 1)) / (within / (n - k))


def test_anova_and_levene(rows):
    groups = list(grouped(rows, "model").values())
    out = st.anova_oneway(rows, "y", "model").first()
    assert out.f_value == pytest.approx(oneway(groups)) and 0 <= out.p_value < 1e-6
    crossed = [np.abs(np.array(g) - np.median(g)) for g in grouped(rows, "model", "grp").values()]
    assert st.levene(rows, "y", ["model", "grp"]).first().f_value == pytest.approx(oneway(crossed))


@pytest.mark.parametrize("formula, factors", [
    ("y ~ model", ["model"]),
    ("y ~ model * grp", ["model", "grp"]),
])
def test_cell_fit_matches_ml_fit(rows, formula, factors):
    data = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc").fit(rows).transform(rows)
    fit = GeneralizedLinearRegression(family="gaussian", featuresCol="features", labelCol="label").fit(data)
    cells = lm.cell_statistics(rows, "y", factors)
    mine = lm.fit_cells(cells, factors)
    assert mine.rss == pytest.approx(fit.summary.deviance, rel=1e-6)
    # RFormula codes an interaction with redundant columns; its criterion counts them.
    redundant = len(fit.coefficients) + 1 - mine.rank
    assert redundant == (4 if "*" in formula else 0)
    assert mine.aic == pytest.approx(fit.summary.aic - 2 * redundant, rel=1e-6)


def test_contrasts_keep_the_fit(rows):
    factors = ["model", "accurate", "grp"]
    cells = lm.cell_statistics(rows, "y", factors)
    a, b = lm.fit_cells(cells, factors), lm.fit_cells(cells, factors, contrasts={"accurate": "sum"})
    assert a.rss == pytest.approx(b.rss) and a.rank == b.rank == 12
    table = lm.model_selection(rows, "y", {"one": ["model"], "all": factors, "two": ["model", "accurate"]})
    found = table.collect()
    assert found[0].delta == 0 and sum(r.weight for r in found) == pytest.approx(1)


def test_empty_cells_lower_the_rank(frame):
    df = frame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 3.0), ("b", "y", 4.0), ("b", "y", 6.0)],
               "f string, g string, y double")
    cells = lm.cell_statistics(df, "y", ["f", "g"])
    assert lm.fit_cells(cells, ["f", "g"]).rank == 3


def test_factorial_tables(rows):
    two = {r.term: r for r in lm.anova_factorial(rows, "y", ["model", "grp"]).collect()}
    alone = st.anova_oneway(rows, "y", "model").first()
    cells = lm.cell_statistics(rows, "y", ["model", "grp"])
    main = lm.fit_cells(cells, ["model", "grp"], interactions=False)
    only = lm.fit_cells(cells, ["grp"])
    assert two["model"].sum_sq == pytest.approx(only.rss - main.rss)
    assert two["model"].dof == alone.df_between == 2
    three = lm.anova_factorial(rows, "y", ["model", "grp"], 3, {"model": "sum", "grp": "sum"})
    last = {r.term: r for r in three.collect()}
    assert last["model:grp"].sum_sq == pytest.approx(two["model:grp"].sum_sq)
    with pytest.raises(ValueError):
        lm.anova_factorial(rows, "y", ["model"], 1)


def test_type_three_matches_least_squares_on_the_rows(rows):
    data = rows.collect()
    y = np.array([r.y for r in data])
    model = np.array([[r.model == "m0", r.model == "m1"] for r in data], float)
    model[[r.model == "m2" for r in data]] = -1
    grp = np.array([[1.0 if r.grp == "A" else -1.0] for r in data])
    both = model * grp
    one = np.ones((len(y), 1))

    def rss(*parts):
        x = np.hstack([one, *parts])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    full = rss(model, grp, both)
    expected = {"model": rss(grp, both) - full, "grp": rss(model, both) - full, "model:grp": rss(model, grp) - full}
    table = lm.anova_factorial(rows, "y", ["model", "grp"], 3, {"model": "sum", "grp": "sum"})
    found = {r.term: r.sum_sq for r in table.collect()}
    assert found.pop("Residuals") == pytest.approx(full)
    assert found == {term: pytest.approx(value) for term, value in expected.items()}


def test_durbin_watson(rows):
    rest = st.residuals(rows, "y", ["model"], "e")
    e = np.array([r.e for r in rest.orderBy("i").collect()])
    expected = (np.diff(e) ** 2).sum() / (e**2).sum()
    assert st.durbin_watson(rest, "e", ["i"]).first().statistic == pytest.approx(expected)


def test_pairwise(rows):
    groups = {k[0]: np.array(v) for k, v in grouped(rows, "model").items()}
    mse = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (400 - 3)
    out = {(r.group_a, r.group_b): r for r in st.pairwise_contrasts(rows, "y", "model").collect()}
    assert set(out) == {("m0", "m1"), ("m0", "m2"), ("m1", "m2")}
    a, b = groups["m0"], groups["m2"]
    assert out[("m0", "m2")].t_value == pytest.approx((b.mean() - a.mean()) / np.sqrt(mse * (1 / len(a) + 1 / len(b))))


def test_boxplot_and_bins(rows):
    out = {r.model: r for r in st.boxplot_stats(rows, ["model"], "y").collect()}
    for (m,), v in grouped(rows, "model").items():
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = [x for x in v if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        r = out[m]
        assert (r.q1, r["median"], r.q3) == (pytest.approx(q1), pytest.approx(med), pytest.approx(q3))
        assert (r.lower_whisker, r.upper_whisker, r.outliers) == (min(inside), max(inside), len(v) - len(inside))
    bins = st.density_bins(rows, ["model"], 10, value="y").collect()
    assert sum(r.mappings for r in bins) == 400
    summary = st.residual_summary(rows, "y", 5).collect()
    assert sum(r.residuals for r in summary) == 400 and {r.bin for r in summary} <= set(range(1, 6))


def test_more_cells_than_fit_a_list(spark):
    """22,500 combinations of levels, fitted by 299 coefficients."""
    import numpy as np
    from pyspark.sql import functions as F

    from termloom.operators.linear_models import cell_statistics, fit_cells

    n = 150
    rows = spark.range(2 * n * n).select(
        F.format_string("a%03d", F.col("id") % n).alias("a"),
        F.format_string("b%03d", (F.col("id") / n).cast("int") % n).alias("b"),
        (F.col("id") % n + 2 * ((F.col("id") / n).cast("int") % n) + F.when(F.col("id") < n * n, 1).otherwise(-1))
        .cast("double").alias("y"),
    )
    fit = fit_cells(cell_statistics(rows, "y", ["a", "b"]), ["a", "b"], interactions=False)
    assert fit.rank == 2 * n - 1 and fit.rows == 2 * n * n
    assert abs(fit.rss - 2 * n * n) < 1e-4
    by_name = dict(zip(fit.names, fit.estimates))
    assert np.isclose(by_name["aa149"], 149) and np.isclose(by_name["bb149"], 298)
