"""Patterns over a triple table ``s, p, o, g``.

The table should be stored partitioned by ``p``: each pattern then reads only its predicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize, materialize_counted

WAYS = 4  # times the edges: more doubled ways are not followed up
COMPACT_EVERY = 16


def merge_graphs(triples: DataFrame, graphs: Sequence[str]) -> DataFrame:
    """RDF merge of named graphs: a triple counts once."""
    return triples.filter(F.col("g").isin(list(graphs))).select("s", "p", "o").distinct()


def match(
    triples: DataFrame, predicates: str | Sequence[str], subject: str = "s", value: str = "o"
) -> DataFrame:
    """One triple pattern as a two-column relation; several predicates are alternatives."""
    names = [predicates] if isinstance(predicates, str) else list(predicates)
    return triples.filter(F.col("p").isin(names)).select(
        F.col("s").alias(subject), F.col("o").alias(value)
    )


def bgp(*patterns: DataFrame) -> DataFrame:
    """Basic graph pattern: join the patterns on the variables they share."""
    out = patterns[0]
    for pattern in patterns[1:]:
        shared = [c for c in out.columns if c in pattern.columns]
        if not shared:
            raise ValueError("a pattern has to share a variable with those before it")
        out = out.join(pattern, shared)
    return out


def optional(df: DataFrame, pattern: DataFrame) -> DataFrame:
    """Keep rows without a match; several matches multiply the row."""
    return df.join(pattern, [c for c in df.columns if c in pattern.columns], "left")


def exists_in_graph(
    df: DataFrame, triples: DataFrame, graph: str, predicate: str, column: str = "iri"
) -> DataFrame:
    """Rows whose term has the predicate in another named graph."""
    there = triples.filter((F.col("g") == graph) & (F.col("p") == predicate))
    return df.join(there.select(F.col("s").alias(column)), column, "left_semi")


def joined_values(
    triples: DataFrame, predicates: str | Sequence[str], subject: str = "s", out: str = "aka"
) -> DataFrame:
    """Distinct values per subject in order, joined by ``'; '``."""
    pairs = match(triples, predicates, subject, "_value").distinct()
    return pairs.groupBy(subject).agg(
        F.array_join(F.array_sort(F.collect_list("_value")), "; ").alias(out)
    )


def descendants(edges: DataFrame, seeds: DataFrame, include_self: bool = True) -> DataFrame:
    """``node``: all nodes with a path of ``child, parent`` edges up to a seed.

    After the seeds' own children, ways are doubled: a round joins the ways of nodes that are not
    yet reached with themselves, so way lengths are 1, 2, 4, … and a hierarchy of depth d ends after
    about log d written rounds, cycles and diamonds too. A node that reaches a reached node by an
    old or a new way is reached, and its ways are dropped. Where nodes have so many ancestors that
    doubled ways outgrow ``WAYS`` times the edges, it goes on breadth first. A lost executor costs
    one round. ``include_self`` is the zero-length path of ``*``; without it a seed appears only if
    an edge leads back to one.
    """
    edges, size = materialize_counted(
        edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "edges"
    )
    start = materialize(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), "seeds")
    newest, found = materialize_counted(_below(edges, start, start if include_self else start.limit(0)), "frontier")
    reached = start.unionByName(newest) if include_self else newest
    ways, doubling = edges, True
    while found and doubling:
        ways = ways.join(reached, ways["child"] == reached["node"], "left_anti")
        first, second = ways.toDF("child", "between"), ways.toDF("between", "parent")
        twice = first.join(second, "between").select("child", "parent").filter("child <> parent").distinct()
        twice, count = materialize_counted(twice, "ways")
        newest, found = materialize_counted(_below(ways.unionByName(twice), reached, reached), "frontier")
        reached = materialize(reached.unionByName(newest), "reached") if found else reached
        doubling = count <= WAYS * size
        ways = twice
    expanded = 0
    newest = reached if found else newest  # nodes reached by long ways have neighbours, too
    while found:
        newest, found = materialize_counted(_below(edges, newest, reached), "frontier")
        reached = reached.unionByName(newest)
        expanded += 1
        if expanded % COMPACT_EVERY == 0:
            reached = materialize(reached, "reached")
    return reached


def _below(ways: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Children of ``nodes`` that are not known yet."""
    return (
        ways.join(nodes, ways["parent"] == nodes["node"], "left_semi")
        .select(F.col("child").alias("node"))
        .distinct()
        .join(known, "node", "left_anti")
    )
