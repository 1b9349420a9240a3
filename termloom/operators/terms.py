"""Term tables to texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.ordering import number_rows
from termloom.functions.text import term_content


def compose_content(terms: DataFrame, legacy: bool = False) -> DataFrame:
    """``id, content`` from name, synonyms and description."""
    content = term_content(F.col("name"), F.col("aka"), F.col("description"), legacy)
    return terms.select("id", content.alias("content"))


def last_content(content: DataFrame, order: str | None = None) -> DataFrame:
    """One ``id, content`` per id: the last by ``order``, or the greatest content without one."""
    key = F.struct(F.col(order), F.col("content")) if order else F.struct("content")
    return content.groupBy("id").agg(F.max_by("content", key).alias("content"))


def content_lookup(terms: DataFrame, content: DataFrame, order: str | None = None) -> DataFrame:
    """Attach the content of each term, its last by ``order``; null where there is none."""
    own = last_content(content, order)
    return terms.join(own, "id", "left").select(*terms.columns, "content")


def unknown_content(terms: DataFrame, content: DataFrame) -> DataFrame:
    """Content rows whose id is no term: an input error to report."""
    return content.join(terms.select("id"), "id", "left_anti")


def filter_namespace(df: DataFrame, prefix: str, column: str = "iri") -> DataFrame:
    return df.filter(F.startswith(column, F.lit(prefix)))


def filter_obsolete(df: DataFrame, column: str = "name") -> DataFrame:
    """Drop names with ``'obsolete '`` anywhere, in lower case."""
    return df.filter(~F.contains(column, F.lit("obsolete ")))


def filter_subset(df: DataFrame, subset: str, prefixes: Iterable[str] = ()) -> DataFrame:
    """Rows of the named subset, or with one of the id prefixes."""
    keep = F.col("subset") == subset
    for prefix in prefixes:
        keep = keep | F.startswith("id", F.lit(prefix))
    return df.filter(keep)


def pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """Add the number of the ``page``, from 0, that a row has in key order.

    The table is sorted once for all pages, and together they are the whole table.
    """
    numbered = number_rows(df, [F.col(key)], "_row")
    page = F.floor((F.col("_row") - 1) / size)
    return numbered.withColumn("page", page).drop("_row")


def page(df: DataFrame, key: str, size: int, number: int) -> DataFrame:
    """One page of a table in key order."""
    return pages(df, key, size).filter(F.col("page") == number).drop("page")
