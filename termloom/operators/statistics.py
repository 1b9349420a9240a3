"""Descriptive statistics and tests over similarity scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.distributions import chi2_p_value, f_p_value, normal_p_value
from termloom.functions.normal import normal_quantile
from termloom.functions.numeric import share
from termloom.functions.ordering import lag_in_order, number_rows
from termloom.functions.quantiles import quantiles
from termloom.session import materialize, materialize_counted

SCORE = "similarity_score"
REPLICATE_ROWS = 100_000  # of a task that draws all replicates of its rows


def analyzed(prepared: DataFrame) -> DataFrame:
    """Rows a model really produced, with ``hit_miss_mapping`` in lower case."""
    return prepared.filter("model_analyzed").withColumn(
        "hit_miss_mapping", F.lower("hit_miss_mapping")
    )


def describe_scores(rows: DataFrame, by: Sequence[str], value: str = SCORE) -> DataFrame:
    """Count, median, mean, spread and range of a value per group."""
    x = F.col(value)
    known = x.isNotNull() & ~F.isnan(x)
    clean = F.when(known, x)
    moments = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mappings"),
        F.avg(clean).alias("mean"),
        F.stddev_samp(clean).alias("sd"),
        F.var_samp(clean).alias("var"),
        F.min(clean).alias("min"),
        F.max(clean).alias("max"),
    )
    medians = quantiles(rows, by, value, {"median": 0.5})
    return moments.join(medians, list(by), "left").select(
        *by, "mappings", "median", "mean", "sd",
        (F.col("sd") / F.sqrt("mappings")).alias("std_err"),
        "var", "min", "max", (F.col("max") - F.col("min")).alias("range"),
    )


def describe_scores_by_accuracy(rows: DataFrame, value: str = SCORE) -> DataFrame:
    """The same per model and accuracy, with the share of the model's mappings."""
    described = describe_scores(rows, ["model", "hit_miss_mapping"], value)
    overall = described.groupBy("model").agg(F.sum("mappings").alias("mappings_overall"))
    percent = share(F.col("mappings") * 100, F.col("mappings_overall"), 2)
    return described.join(overall, "model").withColumn("percent_mappings", percent).select(
        "model", "hit_miss_mapping", "mappings_overall", "mappings", "percent_mappings",
        "median", "mean", "sd", "std_err", "var", "min", "max", "range",
    )


def contingency(rows: DataFrame, a: str, b: str, levels: Sequence | None = None) -> DataFrame:
    """Counts of ``a`` by ``b``; one column per level of ``b``, zero where nothing falls."""
    table = rows.groupBy(a).pivot(b, None if levels is None else list(levels))
    return table.agg(F.count(F.lit(1))).na.fill(0)


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic without continuity correction, as one row.

    Σ(o−e)²/e equals n(Σ o²/(row·column) − 1), so empty cells need no row and the table of
    counts is the only thing that is shuffled.
    """
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    margins_a = cells.groupBy(a).agg(F.sum("o").alias("row"))
    margins_b = cells.groupBy(b).agg(F.sum("o").alias("column"))
    totals = cells.join(margins_a, a).join(margins_b, b).agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("row") * F.col("column"))).alias("q"),
        F.countDistinct(a).alias("rows"),
        F.countDistinct(b).alias("columns"),
    )
    out = totals.select(
        (F.col("n") * (F.col("q") - 1)).alias("statistic"),
        ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("dof"),
        F.col("n").cast("long").alias("n"),
    )
    return out.withColumn("p_value", chi2_p_value("statistic", F.col("dof").cast("double")))


def group_moments(rows: DataFrame, y: str, groups: Sequence[str]) -> DataFrame:
    """Size, mean and sum of squared deviations of each group."""
    return rows.filter(F.col(y).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss"),
    )


def anova_oneway(rows: DataFrame, y: str, groups: str | Sequence[str]) -> DataFrame:
    """One-way analysis of variance as one row; several columns are crossed to one factor."""
    names = [groups] if isinstance(groups, str) else list(groups)
    n, mean = F.col("n"), F.col("mean")
    sums = group_moments(rows, y, names).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum("ss").alias("ss_within"),
        (F.sum(n * mean * mean) - F.pow(F.sum(n * mean), 2) / F.sum(n)).alias("ss_between"),
    )
    out = sums.select(
        (F.col("k") - 1).alias("df_between"),
        (F.col("n") - F.col("k")).alias("df_within"),
        "ss_between",
        "ss_within",
    ).withColumn(
        "f_value",
        F.try_divide(
            F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")
        ),
    )
    dof = [F.col(c).cast("double") for c in ("df_between", "df_within")]
    return out.withColumn("p_value", f_p_value("f_value", *dof))


def levene(rows: DataFrame, y: str, groups: str | Sequence[str]) -> DataFrame:
    """Homogeneity of variance: analysis of variance of the distances to the group median."""
    names = [groups] if isinstance(groups, str) else list(groups)
    medians = quantiles(rows, names, y, {"_median": 0.5})
    distances = rows.join(medians, names).withColumn(
        "_distance", F.abs(F.col(y) - F.col("_median"))
    )
    return anova_oneway(distances, "_distance", names)


def residuals(rows: DataFrame, y: str, factors: Sequence[str], out: str = "residual") -> DataFrame:
    """Distance to the mean of the row's cell: the residual of the full factorial model.

    The means are written, so that Spark knows how small they are and leaves the rows in place.
    """
    means = materialize(rows.groupBy(*factors).agg(F.avg(y).alias("_fitted")), "cell-means")
    return rows.join(means, list(factors)).withColumn(out, F.col(y) - F.col("_fitted")).drop(
        "_fitted"
    )


def lag_residual(rows: DataFrame, residual: str, order: Sequence[str]) -> DataFrame:
    """Add the difference to the row before, in the given total order."""
    return lag_in_order(rows, residual, order, "_previous").withColumn(
        "lag_difference", F.col(residual) - F.col("_previous")
    ).drop("_previous")


def durbin_watson(rows: DataFrame, residual: str, order: Sequence[str]) -> DataFrame:
    """Serial correlation of residuals, as one row."""
    e = F.col(residual)
    differences = lag_residual(rows.select(residual, *order), residual, order)
    return differences.agg(
        (F.sum(F.pow("lag_difference", F.lit(2))) / F.sum(e * e)).alias("statistic")
    )


def durbin_watson_test(
    rows: DataFrame, y: str, factors: Sequence[str], order: Sequence[str],
    replicates: int = 1000, seed: int = 1, table_size: int = 1 << 16,
) -> DataFrame:
    """Serial correlation of a full factorial model's residuals, with a resampled p-value.

    ``statistic, autocorrelation, p_value, replicates`` as one row. Each replicate draws every
    row's residual anew with replacement, fits the cell means again and takes the statistic; the
    p-value is two-sided. A draw is a hash of (seed, replicate, row number), so a task computes the
    draws of a row and of the row before on its own: all replicates are one pass, and the result
    does not depend on the partitioning if ``order`` is total. What is drawn is the table of all
    residuals in ascending order, or, beyond ``table_size``, that many evenly spaced of them.
    """
    spark = rows.sparkSession
    known = rows.filter(F.col(y).isNotNull())
    cells = group_moments(known, y, factors).select(
        *[F.col(f).alias(f"_at_{f}") for f in factors], F.col("mean").alias("_fitted"), F.col("n").alias("_n"),
    )
    names = [f"_at_{f}" for f in factors]
    cells = materialize(number_rows(cells, [F.asc_nulls_first(c) for c in names], "_cell"), "numbered-cells")
    same = [F.col(f).eqNullSafe(F.col(f"_at_{f}")) for f in factors]
    residual = known.join(cells, same).select(*order, "_cell", (F.col(y) - F.col("_fitted")).alias("_e"))
    numbered = materialize(number_rows(residual, [F.col(c) for c in order], "_row"), "numbered-residuals")
    whole = numbered.count()
    schema = "statistic double, autocorrelation double, p_value double, replicates int"
    if not whole:
        return spark.createDataFrame([], schema)
    sizes = np.array([r["_n"] for r in cells.select("_cell", "_n").orderBy("_cell").toLocalIterator()], float)
    drawn = _drawn_from(numbered, whole, table_size)
    linked = lag_in_order(numbered.select("_row", "_cell", "_e"), "_cell", ["_row"], "_cell_before")
    linked = materialize(lag_in_order(linked, "_e", ["_row"], "_e_before"), "linked-residuals")
    # Differences between two cells change with the cells' means; there are few kinds of them.
    jumps = linked.filter(F.col("_cell_before") != F.col("_cell")).groupBy("_cell_before", "_cell").agg(F.count("*").alias("n"))
    kinds = [(r["_cell_before"] - 1, r["_cell"] - 1, r.n) for r in jumps.orderBy("_cell_before", "_cell").collect()]
    # Written first, as an iterator would run one task after the other.
    spread = linked.repartition(math.ceil(whole / REPLICATE_ROWS), "_row")
    sums = materialize(
        spread.mapInPandas(_replicated(drawn, len(sizes), kinds, replicates, seed), "sums binary"), "replicate-sums"
    )
    total = np.zeros(replicates * (2 + len(sizes) + len(kinds)))
    for row in sums.toLocalIterator():  # one per task
        total += np.frombuffer(row.sums)
    squares, steps, by_cell, by_kind = np.split(
        total.reshape(-1, replicates), np.cumsum([1, 1, len(sizes)]), axis=0
    )
    mean = by_cell / sizes[:, None]
    rest = squares[0] - (mean * mean * sizes[:, None]).sum(axis=0)
    steps = steps[0].copy()
    for (before, here, count), crossing in zip(kinds, by_kind, strict=True):
        change = mean[here] - mean[before]
        steps += count * change * change - 2 * change * crossing
    got = linked.agg(
        F.sum(F.pow(F.col("_e") - F.col("_e_before"), F.lit(2))).alias("steps"),
        F.sum(F.col("_e") * F.col("_e")).alias("squares"),
        F.sum(F.col("_e") * F.col("_e_before")).alias("products"),
    ).first()
    if not got.squares:
        return spark.createDataFrame([(None, None, None, replicates)], schema)
    statistic = (got.steps or 0.0) / got.squares
    below = float(np.mean(steps / rest < statistic))
    p_value = 2 * min(below, 1 - below)
    return spark.createDataFrame([(statistic, (got.products or 0.0) / got.squares, p_value, replicates)], schema)


def _drawn_from(numbered: DataFrame, whole: int, size: int) -> np.ndarray:
    """Residuals in ascending order, or ``size`` evenly spaced ones of them."""
    ranked = number_rows(numbered.select("_e"), [F.col("_e")], "_place")
    if whole > size:
        k = F.ceil((F.col("_place") - 1) * (size / whole) - 0.5)
        ranked = ranked.filter(
            k.between(0, size - 1) & (F.floor((k + 0.5) * (whole / size)) + 1 == F.col("_place"))
        )
    return np.array([r["_e"] for r in ranked.orderBy("_place").toLocalIterator()])


def _replicated(drawn: np.ndarray, cells: int, kinds: list[tuple[int, int, int]], replicates: int, seed: int):
    """Per replicate: squares, squared steps, sums by cell, and steps from one cell to another."""
    place = {(before, here): i for i, (before, here, _) in enumerate(kinds)}

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def draw(hashed: np.ndarray, key: np.uint64) -> np.ndarray:
        number = mixed(hashed + key) >> np.uint64(11)
        return drawn[(number / float(1 << 53) * len(drawn)).astype(np.int64)]

    def run(frames):
        total = np.zeros((2 + cells + len(kinds), replicates))
        keys = mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for frame in frames:
            row, cell = frame["_row"].to_numpy(np.int64), frame["_cell"].to_numpy(np.int64) - 1
            later = frame["_cell_before"].notna().to_numpy()
            before = frame["_cell_before"].fillna(0).to_numpy(np.int64) - 1
            kind = np.array([place.get(x, -1) for x in zip(before.tolist(), cell.tolist(), strict=True)], np.int64)
            kind[~later] = -1
            crossing = np.flatnonzero(kind >= 0)
            hashed, hashed_before = mixed(row.astype(np.uint64)), mixed((row - 1).astype(np.uint64))
            for r, key in enumerate(keys):
                e = draw(hashed, key)
                step = np.where(later, e - draw(hashed_before, key), 0.0)
                total[0, r] += e @ e
                total[1, r] += step @ step
                total[2 : 2 + cells, r] += np.bincount(cell, e, cells)
                total[2 + cells :, r] += np.bincount(kind[crossing], step[crossing], len(kinds))
        yield pd.DataFrame({"sums": [total.tobytes()]})

    return run


def pairwise_contrasts(rows: DataFrame, y: str, group: str) -> DataFrame:
    """All differences of group means with pooled standard error and studentised statistic.

    One row per level is written and joined with itself; the pooled variance is a scalar. Adjusted
    p-values, also of models with several factors, come from ``linear_models.model_contrasts``.
    """
    moments = materialize(group_moments(rows, y, [group]).withColumnRenamed(group, "g"), "moments")
    mse = moments.agg(F.sum("ss") / (F.sum("n") - F.count(F.lit(1)))).scalar()
    a, b = moments.alias("a"), moments.alias("b")
    difference = F.col("b.mean") - F.col("a.mean")
    error = F.sqrt(mse * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return a.join(b, F.col("a.g") < F.col("b.g")).select(
        F.col("a.g").alias("group_a"),
        F.col("b.g").alias("group_b"),
        difference.alias("difference"),
        error.alias("std_error"),
        (difference / error).alias("t_value"),
        (F.abs(difference) / error * F.sqrt(F.lit(2.0))).alias("studentised"),
    )


def boxplot_stats(rows: DataFrame, by: Sequence[str], value: str = SCORE) -> DataFrame:
    """Quartiles, whisker ends and number of outliers beyond 1.5 interquartile ranges."""
    quartiles = quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x = F.col(value)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.filter(x.isNotNull())
        .join(quartiles, list(by))
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("lower_whisker"),
            F.max(F.when(inside, x)).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def binned(value: Column, bins: int, low: float, high: float) -> Column:
    """Bin 1 to ``bins`` over ``[low, high)``; 0 below and ``bins + 1`` from ``high`` on."""
    return F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins))


def density_bins(
    rows: DataFrame, by: Sequence[str], bins: int = 50, low: float = 0.0, high: float = 1.0,
    value: str = SCORE,
) -> DataFrame:
    """Counts per bin of the value range."""
    return rows.filter(F.col(value).isNotNull()).groupBy(
        *by, binned(F.col(value), bins, low, high).alias("bin")
    ).agg(F.count(F.lit(1)).alias("mappings"))


GRID, REACH = 512, 9.0  # points of a density, and standard deviations that a kernel reaches


def density(
    rows: DataFrame, by: Sequence[str], value: str = SCORE, low: float | None = None, high: float | None = None,
    points: int = GRID,
) -> DataFrame:
    """Gaussian kernel density of each group on one grid: the groups' columns, ``x`` and ``density``.

    The grid has ``points`` points from ``low`` to ``high``, by default the ends of all values. The
    bandwidth is 0.9 n^(-1/5) times the lesser of sd and quartile distance / 1.34 (if that is zero
    the sd, the least value's size, or 1, whichever is first above zero). Each value is shared by
    its two neighbouring grid points, also beyond the ends, so what is smoothed are at most as many
    numbers as there are grid points in the range of the values.
    """
    x = F.col(value).cast("double")
    clean = rows.filter(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_x"))
    if low is None or high is None:
        ends = clean.agg(F.min("_x").alias("low"), F.max("_x").alias("high")).first()
        low, high = (ends.low if low is None else low), (ends.high if high is None else high)
    if low is None:
        return rows.select(*by, F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    if not low < high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / (points - 1)
    quartiles = quantiles(clean, by, "_x", {"_q1": 0.25, "_q3": 0.75})
    spread = clean.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("_sd"),
        F.abs(F.min("_x")).alias("_least"),
    )
    lesser = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    width = F.coalesce(*[F.when(c > 0, c) for c in (lesser, F.col("_sd"), F.col("_least"))], F.lit(1.0))
    groups = _named(by, "_of_")
    widths = materialize(
        _same(spread, quartiles, by).select(
            *[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], F.col("_n"),
            (width * 0.9 * F.pow("_n", F.lit(-0.2))).alias("_width"),
        ),
        "widths",
    )
    place = (F.col("_x") - low) / step
    share_ = place - F.floor(place)
    bins = clean.groupBy(*by, F.floor(place).alias("_bin")).agg(
        F.sum(1 - share_).alias("_left"), F.sum(share_).alias("_right")
    )
    halves = F.explode(F.array(
        F.struct(F.col("_bin").alias("bin"), F.col("_left").alias("weight")),
        F.struct((F.col("_bin") + 1).alias("bin"), F.col("_right").alias("weight")),
    ))
    heights = bins.select(*by, halves.alias("_h")).filter("_h.weight > 0").groupBy(*by, F.col("_h.bin").alias("_bin")).agg(
        F.sum("_h.weight").alias("_weight")
    )
    same = [F.col(b).eqNullSafe(F.col(g)) for b, g in zip(by, groups, strict=True)]
    reach = F.ceil(F.col("_width") * REACH / step).cast("long")
    first, last = F.greatest(F.col("_bin") - reach, F.lit(0)), F.least(F.col("_bin") + reach, F.lit(points - 1).cast("long"))
    spread_out = heights.join(widths, same).filter(first <= last).select(
        *by, "_n", "_width", "_weight", "_bin", F.explode(F.sequence(first, last)).alias("_at")
    )
    z = (F.col("_at") - F.col("_bin")) * step / F.col("_width")
    kernel = F.exp(-z * z / 2) * F.col("_weight") / (F.col("_n") * F.col("_width") * math.sqrt(2 * math.pi))
    found = spread_out.groupBy(*by, "_at").agg(F.sum(kernel).alias("density"))
    # Grid points that no kernel reaches have the density zero.
    grid = widths.select(*[F.col(g).alias(b) for b, g in zip(by, groups, strict=True)],
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("_at"))
    zero = grid.withColumn("density", F.lit(0.0))
    return found.unionByName(zero).groupBy(*by, "_at").agg(F.sum("density").alias("density")).select(
        *by, (F.lit(low) + F.col("_at") * step).alias("x"), "density"
    )


def _named(by: Sequence[str], prefix: str) -> list[str]:
    return [prefix + b for b in by]


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join of two tables with one row per group; null groups meet."""
    own = _named(by, "_same_")
    renamed = right.withColumnsRenamed(dict(zip(by, own, strict=True)))
    return left.join(renamed, [F.col(b).eqNullSafe(F.col(o)) for b, o in zip(by, own, strict=True)]).drop(*own)


def hit_rank_histogram(prepared: DataFrame) -> DataFrame:
    """Accurate mappings per model and rank, with their logarithm; skipped concepts rank 0."""
    rank = F.when(F.col("model_analyzed"), F.col("concept_pair_rank")).otherwise(0)
    return (
        prepared.filter(F.col("hit_miss_mapping") == "Hit")
        .groupBy("model", rank.alias("rank"))
        .agg(F.count(F.lit(1)).alias("accurate"))
        .withColumn("log_accurate", F.log10("accurate"))
    )


def residual_summary(rows: DataFrame, residual: str, bins: int = 20) -> DataFrame:
    """Histogram of residuals over their range, each row with the moments of all of them."""
    e = F.col(residual)
    moments = {
        "mean": F.avg(e),
        "sd": F.stddev_samp(e),
        "skewness": F.skewness(e),
        "kurtosis": F.kurtosis(e),
    }
    ends = {"low": F.min(e), "high": F.max(e)}
    packed = F.struct(*[value.alias(name) for name, value in {**ends, **moments}.items()])
    stats = rows.agg(packed).scalar()
    # The largest residual belongs to the last bin.
    top = F.lit(bins).cast("long")
    bin_ = F.least(F.width_bucket(e, stats["low"], stats["high"], F.lit(bins)), top)
    counted = rows.filter(e.isNotNull()).groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("residuals")
    )
    return counted.withColumns({name: stats[name] for name in moments})


def quantile_points(rows: DataFrame, residual: str, points: int = 100) -> DataFrame:
    """``point, theoretical, sample``: normal scores against the residuals' order statistics.

    Point i of n stands for the probability (i - 1/2) / n and the value at the exact global position
    of it, so no sample is drawn.
    """
    ranked, whole = _ranked_residuals(rows, residual)
    if not whole:
        return rows.sparkSession.createDataFrame([], "point long, theoretical double, sample double")
    wanted = rows.sparkSession.range(1, points + 1).select(
        F.col("id").alias("point"), ((F.col("id") - 0.5) / points).alias("p"),
    ).withColumn("_at", F.ceil(F.col("p") * whole).cast("long"))
    return ranked.join(wanted, F.col("_place") == F.col("_at")).select(
        "point", normal_quantile(F.col("p")).alias("theoretical"), F.col("_e").alias("sample")
    )


def normality(rows: DataFrame, residual: str) -> DataFrame:
    """``n, statistic, p_value`` as one row: squared correlation of all residuals and normal scores.

    The statistic is W' with the scores of (i - 3/8) / (n + 1/4) for the exact positions i of all
    rows. Its p-value uses the published normal approximation, made for 5 to 5,000 rows; with fewer
    rows there is none, beyond it is extrapolated. Residuals without spread have no statistic.
    """
    ranked, whole = _ranked_residuals(rows, residual)
    score = normal_quantile((F.col("_place") - 0.375) / (F.lit(whole) + 0.25))
    # Centred values: their products do not cancel.
    centre = F.lit(ranked.agg(F.avg("_e")).first()[0])
    e = F.col("_e") - centre
    sums = ranked.select(e.alias("_e"), score.alias("_m")).agg(
        F.sum(F.col("_e") * F.col("_m")).alias("em"), F.sum(F.col("_e") * F.col("_e")).alias("ee"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"),
    )
    w = F.try_divide(F.col("em") * F.col("em"), F.col("ee") * F.col("mm"))
    u = math.log(whole) if whole > 1 else 1.0
    v = math.log(u) if u > 0 else 0.0
    p_value = F.lit(None).cast("double")
    if whole >= 5:
        z = (F.ln(1 - F.col("statistic")) - (1.0521 * (v - u) - 1.2725)) / (1.0308 - 0.26758 * (v + 2 / u))
        p_value = normal_p_value(z)
    return sums.select(F.lit(whole).cast("long").alias("n"), w.alias("statistic")).withColumn("p_value", p_value)


def _ranked_residuals(rows: DataFrame, residual: str) -> tuple[DataFrame, int]:
    e = F.col(residual).cast("double")
    clean = rows.filter(e.isNotNull() & ~F.isnan(e)).select(e.alias("_e"))
    ranked, whole = materialize_counted(number_rows(clean, [F.col("_e")], "_place"), "ranked-residuals")
    return ranked, whole
