"""Positions within groups and within a global order, safe for hot groups.

A plain window puts each group into one task. That is right for the short groups of a mapping
set, and wrong when one group holds a large part of the table. So groups above ``HOT_GROUP_ROWS``
are cut into range chunks: positions are counted inside each chunk and shifted by the totals of
the chunks before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import materialize

HOT_GROUP_ROWS = 2_000_000


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _until_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def range_chunks(df: DataFrame, order: Sequence[Column], chunk: str = "_chunk") -> DataFrame:
    """Number the ranges of a distributed sort.

    The result is written, so a chunk number stays the same whatever is computed again later.
    """
    cut = df.repartitionByRange(*order).withColumn(chunk, F.spark_partition_id())
    return materialize(cut, "chunks")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Add running sums (long) per group, e.g. ``{"rank": lit(1)}`` for a row number.

    ``group_rows`` is a bound the caller knows for the group size (K after a top-K); without it
    one aggregation looks for hot groups first.
    """
    short = group_rows is not None and group_rows <= HOT_GROUP_ROWS
    hot = None
    if not short:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        hot = sizes.filter(F.col("_rows") > HOT_GROUP_ROWS).select(*keys)
        short = hot.isEmpty()
    if short:
        return _totals(df, keys, order, totals)
    cold_rows = _matched(df, hot, keys, "left_anti")
    hot_rows = _matched(df, hot, keys, "left_semi")
    split = _chunked_totals(hot_rows, keys, order, totals)
    return _totals(cold_rows, keys, order, totals).unionByName(split)


def _matched(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which a null key equals a null key, as it does in a window."""
    hot = hot.toDF(*[f"_hot_{k}" for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(hot, same, how)


def _totals(df, keys, order, totals):
    window = _until_here(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumns(
        {name: F.sum(value).over(window) for name, value in totals.items()}
    )


def _chunked_totals(df, keys, order, totals):
    cut = range_chunks(df, [F.col(k) for k in keys] + list(order))
    chunk_keys = [*keys, "_chunk"]
    sums = cut.groupBy(*chunk_keys).agg(
        *[F.sum(value).alias(f"_all_{name}") for name, value in totals.items()]
    )
    earlier = _before(Window.partitionBy(*keys).orderBy("_chunk"))
    shifts = sums.select(
        *chunk_keys,
        *[
            F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_shift_{name}")
            for name in totals
        ],
    )
    inside = _until_here(Window.partitionBy(*chunk_keys).orderBy(*order))
    local = cut.withColumns({name: F.sum(value).over(inside) for name, value in totals.items()})
    named = shifts.withColumnsRenamed({k: f"_at_{k}" for k in chunk_keys})
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in chunk_keys]
    return local.join(named, same).select(
        *df.columns,
        *[(F.col(n) + F.col(f"_shift_{n}")).alias(n) for n in totals],
    )


def row_number_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    group_rows: int | None = None,
) -> DataFrame:
    """1, 2, 3 … within each group."""
    return running_totals(df, keys, order, {name: F.lit(1)}, group_rows)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row") -> DataFrame:
    """1, 2, 3 … over the whole table, without a single-task sort."""
    return _chunked_totals(df, [], order, {name: F.lit(1)})


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Rows beyond ``k`` are dropped before the shuffle, so a hot group sends ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_position", F.row_number().over(window))
        .filter(F.col("_position") <= k)
        .drop("_position")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row of each group, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns]
    )


def lag_in_order(
    df: DataFrame, column: str, order: Sequence[str], out: str = "previous"
) -> DataFrame:
    """Value of the row before in a total order over the whole table.

    Each range chunk is handled on its own; its first row takes the last value of the chunk
    before, from a table with one row per chunk.
    """
    columns = [F.col(c) for c in order]
    cut = range_chunks(df, columns)
    inside = Window.partitionBy("_chunk").orderBy(*columns)
    ends = cut.groupBy("_chunk").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    shifted = ends.select(
        "_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_carried")
    )
    return (
        cut.withColumns(
            {out: F.lag(column).over(inside), "_place": F.row_number().over(inside)}
        )
        .join(F.broadcast(shifted), "_chunk")  # one row per shuffle partition
        .withColumn(out, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col(out)))
        .drop("_chunk", "_place", "_carried")
    )


def fill_down(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    order: Sequence[Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Carry the last known value of each group down to the rows without one.

    Counting the known values cuts a group into blocks that start with their value, so a block
    needs no window. ``group_rows`` is as in ``running_totals``.
    """
    known = F.col(column).isNotNull()
    blocks = running_totals(
        df, keys, order, {"_block": F.when(known, 1).otherwise(0)}, group_rows
    )
    starts = blocks.filter(known).select(*keys, "_block", F.col(column).alias("_value"))
    filled = blocks.join(starts, [*keys, "_block"], "left").withColumn(column, F.col("_value"))
    return filled.select(*df.columns)
