"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r_round(value: Column, digits: int = 0) -> Column:
    """Round with ties to the even digit."""
    return F.bround(value, digits)


def cast_rank(value: Column) -> Column:
    """To integer by rounding with ties to even; a plain cast would cut the fraction off."""
    return F.bround(value.cast("double"), 0).cast("int")


def share(part: Column, whole: Column, digits: int) -> Column:
    """Rounded share; null where the whole is zero."""
    return r_round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def zscore(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Centre and scale by mean and sample standard deviation over all rows.

    The two numbers are one scalar subquery, so the rows themselves are not moved.
    """
    both = F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    stats = df.agg(both).scalar()
    scaled = (F.col(column) - stats["mean"]) / stats["sd"]
    return df.withColumn(out or f"{column}_norm", scaled)
