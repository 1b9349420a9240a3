"""Writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.mappings import order_mappings

ROWS_PER_FILE = 500_000


@dataclass(frozen=True)
class RunConfig:
    """One dataset version: where its term tables lie and where results go."""

    dataset: str
    version: str
    source_terms: str
    target_terms: str
    output: str


def write_mappings(mappings: DataFrame, path: str, form: str = "csv") -> None:
    """Mapping set in sink order; CSV with a header for exchange, or Parquet.

    The sort is a distributed range sort, and files follow its order.
    """
    writer = order_mappings(mappings).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def publish(mappings: DataFrame, config: RunConfig) -> DataFrame:
    """Write mapping sets with a ``model`` column to their own dataset and version.

    Only the models at hand are replaced; other models and versions stay as they are. Files are
    compressed and of bounded length; each row carries its creation time. Returns what the version
    holds then.
    """
    path = f"{config.output}/{config.dataset}/{config.version}/mappings"
    (
        mappings.withColumn("created", F.current_timestamp())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .option("header", True)
        .option("escape", '"')
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .csv(path)
    )
    return read_published(mappings.sparkSession, config, mappings)


def read_published(spark: SparkSession, config: RunConfig, like: DataFrame) -> DataFrame:
    path = f"{config.output}/{config.dataset}/{config.version}/mappings"
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields
        if f.name != "model"
    )
    rows = (
        spark.read.schema(f"{fields}, created timestamp, model string")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
        .withColumns({"dataset": F.lit(config.dataset), "version": F.lit(config.version)})
    )
    # CSV cannot tell an empty comment from none.
    return rows.na.fill("", ["comment"]) if "comment" in rows.columns else rows
