"""Trie of conversation prefixes, as balanced parentheses per shard.

Turns travel as 128-bit fingerprints of role and text. Conversations are sorted by their sequences
and cut into shards of ranges, so a shard is a run of the trie's preorder, whatever its prefixes
are, and a first turn that all have in common, or a conversation with thousands of copies, spans
several shards. A shard writes its nodes as balanced parentheses: the closing parenthesis delimits
a subtree, ranks of leaf pairs count leaves, ranks of ends give members, and cumulated arrays give
savings. Nodes on the path that a shard shares with its neighbour are its spine: each shard holds
a part of them, and they are put together afterwards, with sums along the spines only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.parentheses import Parentheses
from termloom.llm.text_arrays import ranges
from termloom.session import materialize

SHARD_TURNS = 200_000
HEAD = 9
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_PART = (
    "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends array<long>, node string, parent_node string, bytes long, sides array<int>"
)


def paths(conversations: DataFrame, id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``conv_id, turns``: fingerprints and bytes of the turns in their order.

    Null turns come first; equal ones are ordered by fingerprint, which is arbitrary but fixed.
    Null roles and texts are empty. Rows without a conversation's number belong to none.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    item = F.struct(
        F.col(turn).alias("turn"), F.xxhash64(F.lit(1), role_, text_).alias("a"), F.xxhash64(F.lit(2), role_, text_).alias("b"),
        F.octet_length(text_).alias("bytes"),
    )
    rows = conversations.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), item.alias("item"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("turns"))


def with_common_heads(own: DataFrame, family: int = 5, head: int = HEAD) -> DataFrame:
    """Put the first h turns of conversation c - c % ``family`` in place of c's own first h turns.

    h is the unsigned crc32 of c as decimal text, modulo ``head``. A shorter conversation gives all
    its turns, an absent one none. Only ``head - 1`` turns of each conversation are joined.
    """
    own = materialize(own, "paths")
    first = own.select(F.col("conv_id").alias("of"), F.slice("turns", 1, head - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("int")
    given = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), h))
    rest = F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))
    joined = own.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("of"), "left")
    return joined.select("conv_id", F.concat(given, rest).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """Number of equal pairs that two flat arrays of pairs begin with."""
    shorter = (F.least(F.size(a), F.size(b)) / 2).cast("int")
    differ = F.filter(
        F.sequence(F.lit(0), F.greatest(shorter, F.lit(1)) - 1),
        lambda i: (a[2 * i] != b[2 * i]) | (a[2 * i + 1] != b[2 * i + 1]),
    )
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)), shorter))


def _with_edges(ordered: DataFrame) -> DataFrame:
    """Add how many turns the shard's first and last sequence share with its neighbours."""
    ends = ordered.groupBy("shard").agg(
        F.min(F.struct("path", "conv_id"))["path"].alias("first"), F.max(F.struct("path", "conv_id"))["path"].alias("last")
    )
    order = Window.orderBy("shard")  # one row per shard
    left = ends.withColumn("before", F.lag("last").over(order)).select(
        F.col("shard").alias("of"),
        F.when(F.col("before").isNull(), 0).otherwise(_common(F.col("before"), F.col("first"))).alias("left"),
    )
    edges = materialize(left.withColumn("right", F.coalesce(F.lead("left").over(Window.orderBy("of")), F.lit(0))), "edges")
    return ordered.join(edges, F.col("shard") == F.col("of")).drop("of")


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range, none of them empty, from minima over powers of two."""
    table = [values]
    while 2 ** len(table) <= len(values):
        step = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for p in np.unique(power):
        own = power == p
        out[own] = np.minimum(table[p][low[own]], table[p][high[own] - 2**p])
    return out


def _shared_with_previous(pairs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common turns of each sequence and the one before; checks that they are sorted."""
    shared = np.zeros(len(size), np.int64)
    todo = np.arange(1, len(size))
    depth = 0
    while len(todo):
        both = (size[todo] > depth) & (size[todo - 1] > depth)
        assert (size[todo[~both]] >= size[todo[~both] - 1]).all(), "sequences are not sorted"
        todo = todo[both]
        now, before = pairs[start[todo] + depth], pairs[start[todo - 1] + depth]
        same = (now == before).all(axis=1)
        rises = np.where(now[:, 0] == before[:, 0], now[:, 1] > before[:, 1], now[:, 0] > before[:, 0])
        assert (same | rises).all(), "sequences are not sorted"
        todo = todo[same]
        depth += 1
        shared[todo] = depth
    return shared


def _digests(pairs: np.ndarray) -> list[str]:
    """A name for each prefix of a sequence, the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.hexdigest()]
    for turn in pairs:
        state.update(turn.tobytes())
        out.append(state.copy().hexdigest())
    return out


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of a shard; those of its spine hold this shard's part and have a name."""
    paths_, ids = table["path"].combine_chunks(), table["conv_id"].to_numpy()
    pairs = paths_.flatten().to_numpy().reshape(-1, 2)
    sizes = table["bytes"].combine_chunks().flatten().to_numpy().astype(np.int64)
    length = np.diff(paths_.offsets.to_numpy()) // 2
    start = np.cumsum(length) - length
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    shared = _shared_with_previous(pairs, start, length)
    new = length - shared
    count = 1 + int(new.sum())
    # Each sequence closes what it does not share with the one before and opens its own.
    runs = np.zeros((len(ids) + 1, 2), np.int64)
    runs[:-1, 1], runs[1:-1, 0], runs[-1, 0] = new, length[:-1] - shared[1:], length[-1] + 1
    tree = Parentheses(np.concatenate([[True], np.repeat(np.tile([False, True], len(runs)), runs.ravel())]))
    at = np.flatnonzero(tree.open)
    close = tree.close(at)
    after = tree.opened[close]  # the subtree of node i is the nodes i to after[i]
    depth = np.concatenate([[0], ranges(shared + 1, new)])
    weight = np.concatenate([[0], sizes[ranges(start + shared, new)]])
    parent = np.arange(count) - 1
    firsts = (np.cumsum(new) - new + 1)[new > 0]
    owner = np.zeros(len(tree.open), np.int64)
    owner[close] = np.arange(count)
    parent[firsts] = owner[tree.outer_close(at[firsts])]
    ending = np.cumsum(new)  # the node at which each conversation ends
    low, high = np.searchsorted(ending, np.arange(count)), np.searchsorted(ending, after)
    members = high - low
    spine = np.zeros(count, bool)
    sides = [[] for _ in range(count)]
    names: dict[int, str] = {}
    path = [int(ending[-1])]
    while path[-1]:
        path.append(int(parent[path[-1]]))
    chains = ((list(range(left + 1)), 0, left), (path[::-1][: right + 1], len(ids) - 1, right))
    for side, (chain, row, reach) in enumerate(chains):
        for node, name in zip(chain, _digests(pairs[start[row] : start[row] + reach]), strict=True):
            names[node] = name
            spine[node] = True
            sides[node].append(side)

    def below(values: np.ndarray) -> np.ndarray:
        """Sum over the subtree; nodes of the spine are counted later."""
        total = np.concatenate([[0], np.cumsum(np.where(spine, 0, values))])
        return total[after] - total[: len(values)]

    last = np.searchsorted(ending, np.arange(count), "right")
    text = lambda nodes: pa.array([names.get(i) for i in nodes], pa.string())
    least = _least(ids, low, high)
    return pa.table({
        "shard": pa.array(np.full(count, table["shard"][0].as_py()), pa.int32()),
        "depth": depth,
        "conv_id": least,
        "parent_conv_id": pa.array(least[parent], mask=(np.arange(count) == 0) | spine[parent]),
        "n_convs": members,
        "n_children": np.bincount(parent[1:][~spine[1:]], minlength=count),
        "n_leaves": below(tree.leaf().astype(np.int64)),
        "saved_tokens": below((members - 1) * weight),
        "ends": pa.array([ids[a:b] for a, b in zip(low, last, strict=True)], pa.list_(pa.int64())),
        "node": text(range(count)),
        "parent_node": text([-1, *parent[1:].tolist()]),
        "bytes": weight,
        "sides": pa.array(sides, pa.list_(pa.int32())),
    })


def _digest_of_ends(pieces: DataFrame) -> DataFrame:
    """``of, sha`` of the ids of each node; pieces stream in order, so none is held as a whole."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            for name, piece in zip(batch.column("node").to_pylist(), batch.column("piece"), strict=True):
                if name != node:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["of", "sha"])
                    node, state = name, hashlib.sha256(piece.as_buffer())
                else:
                    state.update(b",")
                    state.update(piece.as_buffer())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["of", "sha"])

    streams = pieces.repartition("node").sortWithinPartitions("node", "shard").select("node", "piece")
    return streams.mapInArrow(run, "of string, sha string")


def _joined_spines(parts: DataFrame) -> DataFrame:
    """One row per node of a spine, put together from the shards that hold a part of it."""
    held = parts.filter(F.col("node").isNotNull())
    chains = held.select("node", "shard", "depth", F.explode("sides").alias("side"))
    merged = materialize(
        held.groupBy("node").agg(
            F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_node").alias("parent_node"),
            F.max("bytes").alias("bytes"),
            F.min(F.struct("shard", F.col("sides")[0].alias("side"))).alias("home"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ),
        "spines",
    )
    children = merged.groupBy(F.col("parent_node").alias("of")).agg(F.count("*").alias("more"))
    counted = merged.join(children, F.col("node") == F.col("of"), "left").select(
        *[c for c in merged.columns if c != "n_children"],
        (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"),
    )
    # What a node adds to all nodes above it lies on one chain, its home.
    adds = counted.select(
        F.col("node").alias("of"), "home", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    here = (F.col("shard") == F.col("home.shard")) & (F.col("side") == F.col("home.side"))
    downward = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    valued = chains.join(adds, F.col("node") == F.col("of")).select(
        "node", "shard", "side", "depth", *[F.when(here, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")]
    )
    above = valued.select("node", *[F.sum(c).over(downward).alias(c) for c in ("leaf", "saved")]).groupBy(
        F.col("node").alias("of")
    ).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    parents = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return counted.join(above, F.col("node") == F.col("of")).join(parents, F.col("parent_node") == F.col("up"), "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
    )


def prefix_trie(sequences: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``conv_id, turns``, and the ends of the nodes that span shards.

    Nodes are ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends`` (ascending ids of the
    members without further turns) and ``node``. A node on a spine has a name in ``node`` and null
    ``ends``: its ids are the second frame's ``node, shard, ends``, in the order of ``shard``.
    ``conv_id`` has to be unique. Without conversations there are no nodes. A conversation is one
    row of 20 bytes a turn, so its length is bounded by the memory of a task.
    """
    spark = sequences.sparkSession
    flat = materialize(
        sequences.select(
            "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("path"),
            F.transform("turns", lambda t: t["bytes"]).alias("bytes"),
        ),
        "sequences",
    )
    turns = flat.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    cut = flat.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    ordered = materialize(cut, "ordered")
    sorted_ = _with_edges(ordered).repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = materialize(sorted_.groupBy("shard").applyInArrow(_shard, _PART), "trie-parts")
    spines = materialize(_joined_spines(parts), "joined-spines")
    inner = parts.filter(F.col("node").isNull())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    up = spines.select(F.col("node").alias("of"), F.col("conv_id").alias("up"))
    on_spine = inner.filter(F.col("parent_node").isNotNull()).join(up, F.col("parent_node") == F.col("of"))
    none = F.lit(None).cast("string").alias("node")
    nodes = (
        inner.filter(F.col("parent_node").isNull()).select(*columns, none)
        .unionByName(on_spine.withColumn("parent_conv_id", F.col("up")).select(*columns, none))
        .unionByName(spines.withColumn("ends", F.lit(None).cast("array<long>")).select(*columns, "node"))
    )
    return nodes, parts.filter(F.col("node").isNotNull() & (F.size("ends") > 0)).select("node", "shard", "ends")


def with_digest(nodes: DataFrame, spine_ends: DataFrame) -> DataFrame:
    """Nodes with ``ends_sha256``, the SHA-256 of the comma-joined ends, in place of ``ends``."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    columns = [c for c in nodes.columns if c not in ("ends", "node")]
    whole = nodes.filter(F.col("node").isNull()).select(*columns, F.sha2(joined("ends"), 256).alias("ends_sha256"))
    digests = _digest_of_ends(spine_ends.select("node", "shard", joined("ends").alias("piece")))
    spread = nodes.filter(F.col("node").isNotNull()).join(digests, F.col("node") == F.col("of"), "left")
    return whole.unionByName(spread.select(*columns, F.coalesce("sha", F.lit(_NO_ENDS)).alias("ends_sha256")))
