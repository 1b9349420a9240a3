"""Connected components of links between numbered things, as joins that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize


def smallest_reachable(links: DataFrame, least: str = "a", most: str = "b") -> DataFrame:
    """``node, root``: for each linked node the smallest node it is connected with.

    Each round gives a node the smallest root among its neighbours and then the root of that
    root, so a chain of n links ends after about log n rounds. Rounds are written, so a lost
    executor costs one of them.
    """
    links = links.select(F.col(least).alias("a"), F.col(most).alias("b")).distinct()
    ways = materialize(
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ways"
    )
    # The first round needs no join: every neighbour is its own root.
    roots = materialize(
        ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("root")
        ),
        "roots",
    )
    while True:
        near = (
            ways.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("m"))
        )
        better = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("m")
        )
        jump = roots.select(F.col("node").alias("m"), F.col("root").alias("far"))
        found = better.join(jump, "m").select("node", "old", F.least("m", "far").alias("root"))
        found = materialize(found, "roots")
        roots = found.select("node", "root")
        if found.filter("root <> old").isEmpty():
            return roots
