"""Exact quantiles without collecting a group, in two scans.

Spark's ``median`` and ``percentile`` keep all distinct values of a group in one task. Here the
first scan builds Spark's mergeable quantile summary, which bounds the rank of each value it
returns, and takes from it a bracket around each wanted order statistic. The second scan counts
what lies below each bracket and keeps, as counted values, only what lies inside: a small share of
a large group. Those few are written. Should they still be too many to sort, their range is
narrowed by histograms over the digits of a 64-bit number that orders as the values do, whatever
they are. Counts prove that a bracket holds its order statistic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import materialize

SHIFTS = (52, 40, 28, 16, 4, 0)  # twelve bits more each time
SORT_ROWS = 50_000
ACCURACY = 2_000  # of the summary: its ranks are right to a share of one in so many

_RANGE = ["_lo", "_hi"]


@F.pandas_udf(T.LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """A number with the order of the doubles: their bits, turned round below zero."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """One row per group with one column per entry of ``probs``.

    Linear interpolation between neighbouring order statistics; nulls and NaNs are left out. Null
    keys form a group.
    """
    keys = [*by, "_all"]
    x = F.col(value).cast("double") + 0.0  # no negative zero
    rows = df.select(*by, F.lit(0).alias("_all"), x.alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    brackets = materialize(_brackets(rows, keys, probs), "quantile-brackets")
    inside = materialize(_kept(rows, brackets, keys, probs), "quantile-values")
    targets = materialize(_bracket_targets(inside, brackets, keys, probs), "quantile-targets")
    values = inside.filter("_x IS NOT NULL").withColumn("_k", _ordered("_x"))
    missed = (F.col("_position") < F.col("_below")) | (F.col("_position") >= F.col("_below") + F.col("_rows"))
    if not targets.filter(missed).isEmpty():  # a bracket without its value: take all rows
        values = rows.withColumns({"_k": _ordered("_x"), "_n": F.lit(1).cast("long")})
        targets = materialize(_targets(values, keys, probs), "quantile-targets")
    return _selected(values, targets, by, keys, probs)


def _brackets(rows: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """``_all_rows`` of each group, and two values ``_low_i`` and ``_high_i`` around each quantile.

    The summary's ranks are off by ``_all_rows / ACCURACY`` at most, and a bracket reaches twice as
    far. Groups too small for that margin are kept as a whole.
    """
    reach = 2.0 / ACCURACY
    ends = [(max(0.0, p - reach), min(1.0, p + reach)) for p in probs.values()]
    wanted = F.array(*[F.lit(float(p)) for pair in ends for p in pair])
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all_rows"), F.min("_x").alias("_least"), F.max("_x").alias("_most"),
        F.percentile_approx("_x", wanted, ACCURACY).alias("_b"),
    )
    small = F.col("_all_rows") <= 4 * ACCURACY
    columns = []
    for i in range(len(probs)):
        columns.append(F.when(small, F.col("_least")).otherwise(F.col("_b")[2 * i]).alias(f"_low_{i}"))
        columns.append(F.when(small, F.col("_most")).otherwise(F.col("_b")[2 * i + 1]).alias(f"_high_{i}"))
    return found.select(*keys, "_all_rows", *columns)


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(named, same).drop(*[f"_of_{k}" for k in keys])


def _kept(rows: DataFrame, brackets: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Values inside a bracket with their count; others only as counts by the brackets above them."""
    x, count = F.col("_x"), len(probs)
    inside = reduce(or_, [x.between(F.col(f"_low_{i}"), F.col(f"_high_{i}")) for i in range(count)])
    under = reduce(add, [F.when(x < F.col(f"_low_{i}"), 1 << i).otherwise(0).cast("long") for i in range(count)])
    sorted_out = _met(rows, brackets, keys).select(
        *keys, F.when(inside, x).alias("_x"), F.when(inside, 0).otherwise(under).cast("long").alias("_under")
    )
    return sorted_out.groupBy(*keys, "_x", "_under").agg(F.count(F.lit(1)).alias("_n"))


def _bracket_targets(
    inside: DataFrame, brackets: DataFrame, keys: list[str], probs: Mapping[str, float]
) -> DataFrame:
    x, n = F.col("_x"), F.col("_n")
    sums = []
    for i in range(len(probs)):
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        below = F.when(x.isNull(), F.col("_under").bitwiseAND(1 << i) != 0).otherwise(x < low)
        sums.append(F.sum(F.when(below, n).otherwise(0)).alias(f"_below_{i}"))
        sums.append(F.sum(F.when(x.between(low, high), n).otherwise(0)).alias(f"_rows_{i}"))
    counted = _met(_met(inside, brackets, keys).groupBy(*keys).agg(*sums), brackets, keys)
    wanted = []
    for i, (name, p) in enumerate(probs.items()):
        for place in _places(name, p, F.col("_all_rows")):
            wanted.append(F.struct(
                F.col(f"_low_{i}").alias("low"), F.col(f"_high_{i}").alias("high"),
                F.col(f"_rows_{i}").alias("rows"), F.col(f"_below_{i}").alias("below"), place.alias("w"),
            ))
    each = counted.select(*keys, F.explode(F.array(*wanted)).alias("_t"))
    return each.select(
        *keys, _ordered("_t.low").alias("_lo"), _ordered("_t.high").alias("_hi"), F.col("_t.rows").alias("_rows"),
        F.col("_t.below").alias("_below"), "_t.w.*",
    )


def _selected(
    rows: DataFrame, targets: DataFrame, by: Sequence[str], keys: list[str], probs: Mapping[str, float]
) -> DataFrame:
    """Order statistics of counted values from ranges that hold them."""
    wide = (F.col("_rows") > SORT_ROWS) & (F.col("_lo") < F.col("_hi"))
    for shift in SHIFTS:
        if targets.filter(wide).isEmpty():
            break
        targets = materialize(
            _narrow(rows, targets.filter(wide), keys, shift).unionByName(targets.filter(~wide)),
            "quantile-targets",
        )
    found = _located(rows, targets, keys, F.col("_k")).groupBy(*by).agg(
        *[_interpolated(name).alias(name) for name in probs]
    )
    # Written too: joined back to the rows, a table of known small size needs no shuffle of them.
    return materialize(found, "quantiles")


def _places(name: str, p: float, rows: Column) -> list[Column]:
    """The two zero-based positions of a quantile, and the weight of the upper one."""
    exact = (rows - 1) * F.lit(float(p))
    return [
        F.struct(
            F.lit(name).alias("_prob"),
            F.lit(upper).alias("_upper"),
            (F.ceil(exact) if upper else F.floor(exact)).cast("long").alias("_position"),
            (exact - F.floor(exact)).alias("_weight"),
        )
        for upper in (False, True)
    ]


def _targets(rows: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Two zero-based positions per group and quantile, with the range of all its values."""
    ranges = rows.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi")
    )
    wanted = [place for name, p in probs.items() for place in _places(name, p, F.col("_rows"))]
    return ranges.select(
        *keys, *_RANGE, "_rows", F.lit(0).cast("long").alias("_below"),
        F.explode(F.array(*wanted)).alias("_w"),
    ).select(*keys, *_RANGE, "_rows", "_below", "_w.*")


def _located(rows: DataFrame, targets: DataFrame, keys: list[str], slot: Column) -> DataFrame:
    """Find the slot of its range that each target falls into.

    ``slot`` orders the values inside a range. Returned with the slot's least value ``_x``, its
    bounds ``_first`` and ``_last``, its row count ``_n`` and the number of rows ``_upto`` its end.
    """
    ranges = targets.select(*keys, *_RANGE, "_below").distinct()
    inside = _met(rows, ranges, keys).filter(F.col("_k").between(F.col("_lo"), F.col("_hi")))
    slots = inside.groupBy(*keys, *_RANGE, "_below", slot.alias("_slot")).agg(
        F.sum("_n").alias("_n"), F.min("_x").alias("_x"), F.min("_k").alias("_first"),
        F.max("_k").alias("_last"),
    )
    window = Window.partitionBy(*keys, *_RANGE).orderBy("_slot")
    upto = F.col("_below") + F.sum("_n").over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cumulated = slots.select("*", upto.alias("_upto")).drop("_below")
    position = F.col("_position")
    return _met(cumulated, targets.drop("_rows", "_below"), [*keys, *_RANGE]).filter(
        (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_n"))
    )


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str], shift: int) -> DataFrame:
    return _located(rows, targets, keys, F.shiftright("_k", shift)).select(
        *keys,
        F.col("_first").alias("_lo"),
        F.col("_last").alias("_hi"),
        F.col("_n").alias("_rows"),
        (F.col("_upto") - F.col("_n")).alias("_below"),
        "_prob", "_upper", "_position", "_weight",
    )


def _interpolated(name: str) -> Column:
    def of(column: str, upper: bool) -> Column:
        return F.max(F.when((F.col("_prob") == name) & (F.col("_upper") == upper), F.col(column)))

    low, high = of("_x", False), of("_x", True)
    weight = of("_weight", False)
    # A difference that is no number, or beyond all numbers, must not spoil the result.
    plain = F.abs(high - low) < F.lit(float("inf"))
    return (
        F.when(low == high, low)
        .when(plain, low + (high - low) * weight)
        .otherwise(F.when(weight == 0, low).otherwise(low * (1 - weight) + high * weight))
    )
