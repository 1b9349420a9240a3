"""Exact top-K cosine similarity join.

Every source is compared with every target, so the work is a matrix product. Both sides are cut
into lanes of bounded size by a hash of their rows; a cell is one source lane against one target
lane. Spark shuffles each lane to its cells, a cell multiplies blocks with numpy in double
precision, and only the best K per source leave it. No pair row is ever built, and neither side
has to fit into one executor. A row travels once per lane of the other side, so the grid is cut on
both sides and its cells follow the cores: what is shuffled grows with the rows, not the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom import schemas
from termloom.functions.ordering import top_by
from termloom.session import materialize

LANE_BYTES = 64 << 20  # one lane of double precision vectors
CELL_FLOPS = 2.5e8  # work that is worth a task of its own
CELL_ROWS = 1_000  # copied rows that cost as much as one more cell
MERGE = 3  # a source row sent to one more target lane, with its results, in target rows
BLOCK_SOURCES, BLOCK_TARGETS = 1024, 512  # their products stay in a core's cache
FLOOR_GROUPS = 128  # of a block's targets, whose maxima give a first floor
DENSE = 0.1  # share of a block from which on one double precision product is cheaper
DIGITS = 9
PRUNE_GAIN = 8


def topk_similar(
    source: DataFrame,
    target: DataFrame,
    k: int = 10,
    min_score: float | None = None,
    lanes: tuple[int, int] | None = None,
    digits: int = DIGITS,
    prune: bool | None = None,
) -> DataFrame:
    """``source, target, score`` of the ``k`` most similar targets of each source.

    Both inputs are ``id, embedding``. Rows that share an id are one thing: a pair of ids has the
    best score of its rows, once. Scores are rounded to ``digits``
    before ranking: the last bits depend on the block shapes, and equal vectors have to tie.
    Ties go to the smaller target id. Vectors without direction (zero, NaN, null) have no score.
    ``min_score`` keeps strictly higher scores; a source without any then has no row.
    ``lanes`` fixes the numbers of source and target lanes. Otherwise one aggregation over both
    inputs takes their sizes, so write vectors that are dear to compute before. With ``prune`` rows
    are grouped by a two-level tree of pivots, and a pair of groups is compared only if the angles
    leave room for a score that can matter. By default that is done for targets beyond one lane's
    memory when the pairs outweigh ``PRUNE_GAIN`` times the work of grouping, unless a probe says, and
    given up when the tree shows, that the groups would copy more rows than the grid does; the result
    is the same.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    most = None
    if lanes is None:
        sizes = _sizes(source, target)
        source_lanes, target_lanes = _planned(source, *sizes)
        if prune is None:
            rows_s, rows_t, dim = sizes
            prune = rows_t > _lane_rows(dim) and rows_s * rows_t > PRUNE_GAIN * 2 * FAN * (rows_s + rows_t)
            most = rows_s * target_lanes + rows_t * source_lanes
            if prune and rows_t > PROBE_ROWS:
                prune = _probed(source, target, k, min_score, sizes) <= most
    else:
        source_lanes, target_lanes = lanes
    if prune:
        found, _ = _pruned(source, target, k, min_score, digits, most=most)
        if found is not None:
            return found
    cells = source_lanes * target_lanes
    best = _lanes(source, "s", source_lanes, target_lanes, cells).cogroup(
        _lanes(target, "t", target_lanes, source_lanes, cells)
    )
    found = best.applyInArrow(_cell(k, min_score, digits), schemas.SCORES)
    if target_lanes == 1:
        return found
    # At most k rows per source and target lane are left.
    return top_by(found, ["source"], [F.desc("score"), F.asc("target")], k)


def _sizes(source: DataFrame, target: DataFrame) -> tuple[int, int, int]:
    """Rows of both sides and the vector length."""
    sizes = {
        row["side"]: row
        for row in source.select(F.lit("s").alias("side"), F.size("embedding").alias("dim"))
        .union(target.select(F.lit("t"), F.size("embedding")))
        .groupBy("side")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("dim").alias("dim"))
        .collect()
    }
    rows = [sizes[side]["rows"] if side in sizes else 0 for side in "st"]
    return *rows, max([1, *[row["dim"] or 1 for row in sizes.values()]])


def plan_lanes(source: DataFrame, target: DataFrame) -> tuple[int, int]:
    """Numbers of lanes from the row counts and the vector length."""
    return _planned(source, *_sizes(source, target))


def _planned(source: DataFrame, rows_s: int, rows_t: int, dim: int) -> tuple[int, int]:
    if not rows_s or not rows_t:
        return 1, 1
    lane_rows = _lane_rows(dim)
    for_memory_s, for_memory_t = math.ceil(rows_s / lane_rows), math.ceil(rows_t / lane_rows)
    parallelism = source.sparkSession.sparkContext.defaultParallelism
    cells = min(math.ceil(2.0 * rows_s * rows_t * dim / CELL_FLOPS), 4 * parallelism)
    # So many target lanes that the copies of both sides and the results to merge are fewest.
    best_t = round(math.sqrt(cells * rows_t / (rows_s * MERGE)))
    target_lanes = max(for_memory_t, min(best_t, cells))
    return max(for_memory_s, math.ceil(cells / target_lanes)), target_lanes


def _lane_rows(dim: int) -> int:
    return max(LANE_BYTES // (8 * dim), 1)


def _lanes(df: DataFrame, side: str, own: int, other: int, cells: int):
    """Hash rows to a lane and send one copy to each cell of that lane."""
    lane = F.pmod(F.xxhash64("id"), F.lit(own))  # all rows of an id together
    opposite = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    number = F.col("_own") * other + F.col("_other")
    if side == "t":
        number = F.col("_other") * own + F.col("_own")
    copies = df.select(
        F.col("id").cast("string").alias("id"), "embedding", lane.alias("_own")
    ).withColumn("_other", opposite)
    # Names of their own, so that a table can be compared with itself.
    copies = copies.select(
        F.col("id").alias(f"{side}_id"),
        F.col("embedding").alias(f"{side}_embedding"),
        number.cast("int").alias(f"{side}_cell"),
    )
    # A task of its own for each cell: by a hash some tasks would have several and others none.
    return copies.repartitionById(cells, f"{side}_cell").groupBy(f"{side}_cell")


def _cell(k: int, min_score: float | None, digits: int):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        source_ids, sources = _unit_rows(left["s_id"], left["s_embedding"])
        target_ids, targets = _unit_rows(right["t_id"], right["t_embedding"])
        out = []
        if len(target_ids):
            # Rows of one target could fill the places of others, so each may take as many.
            copies = pc.max(pc.value_counts(target_ids).field("counts")).as_py()
            narrow = targets.astype(np.float32)
            for start in range(0, len(source_ids), BLOCK_SOURCES):
                block = sources[start : start + BLOCK_SOURCES]
                row, col, score = _best(block, targets, narrow, k * copies, min_score, digits)
                out.append(
                    pa.table(
                        {
                            "source": source_ids.take(pa.array(row + start)),
                            "target": target_ids.take(pa.array(col)),
                            "score": pa.array(score),
                        }
                    )
                )
        if not out:
            return _EMPTY
        found = pa.concat_tables(out)
        repeated = copies > 1 or pc.count_distinct(source_ids).as_py() < len(source_ids)
        return _once(found, k) if repeated else found

    return compare


def _once(found: pa.Table, k: int) -> pa.Table:
    """Best score of each pair of ids, and the ``k`` best of each source."""
    best = found.group_by(["source", "target"]).aggregate([("score", "max")])
    best = best.rename_columns({"score_max": "score"}).select(["source", "target", "score"])
    best = best.sort_by([("source", "ascending"), ("score", "descending"), ("target", "ascending")])
    codes = best["source"].combine_chunks().dictionary_encode().indices.to_numpy()
    begins = np.searchsorted(codes, codes)
    return best.filter(pa.array(np.arange(len(codes)) - begins < k))


_EMPTY = pa.table(
    {
        "source": pa.array([], pa.string()),
        "target": pa.array([], pa.string()),
        "score": pa.array([], pa.float64()),
    }
)


def _unit_rows(ids, embeddings) -> tuple[pa.Array, np.ndarray]:
    """Ids in ascending order and their vectors scaled to length one."""
    table = pa.table({"id": ids, "embedding": embeddings})
    table = table.filter(pc.is_valid(table["embedding"]))
    if not table.num_rows:
        return pa.array([], pa.string()), np.empty((0, 0))
    table = table.take(pc.sort_indices(table["id"]))
    lists = table["embedding"].combine_chunks()
    lengths = pc.list_value_length(lists)
    dim = lengths[0].as_py()
    if pc.min_max(lengths).as_py() != {"min": dim, "max": dim}:
        raise ValueError("embeddings of different lengths cannot be compared")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(-1, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    usable = np.isfinite(norms) & (norms > 0)
    ids = table["id"].combine_chunks()
    if not usable.all():
        ids, vectors, norms = ids.filter(pa.array(usable)), vectors[usable], norms[usable]
    vectors /= norms[:, None]  # they are a copy, and a lane is large
    return ids, vectors


def _best(block, targets, narrow_targets, k, min_score, digits):
    """Best ``k`` target positions per row, by rounded score and then by position.

    A single precision product finds the pairs that may count: its error for unit vectors is
    below ``slack``, so a pair more than twice that below the ``k``-th product of its row cannot.
    Only what is left in the end gets its score in double precision. Found pairs are thinned out
    when they are as many as those kept; until then the floors are lower than need be.
    """
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    found, waiting, count = [], 0, len(block)
    slack = (block.shape[1] + 4) * 2.0**-23 + 10.0**-digits
    floor = np.full(count, -np.inf if min_score is None else min_score - slack)
    narrow = block.astype(np.float32)
    # One buffer for all products: fresh pages for each would cost as much as the product.
    space = np.empty(count * min(BLOCK_TARGETS, len(targets)), np.float32)

    def scored(pairs, low=0, high=len(targets)):
        r, c, _ = pairs
        s = np.round(_scores(block, targets[low:high], r, c - low), digits) + 0.0
        keep = slice(None) if min_score is None else s > min_score
        return r[keep], c[keep], s[keep]

    for start in range(0, len(targets), BLOCK_TARGETS):
        wide = narrow_targets[start : start + BLOCK_TARGETS]
        rough = space[: count * len(wide)].reshape(count, len(wide))
        np.matmul(narrow, wide.T, out=rough)
        bar = floor.astype(np.float32)
        some = np.flatnonzero(rough.max(axis=1) >= bar)  # few sources have a new pair in a late block
        if len(some) > count // 2:
            some, part = np.arange(count), rough
        else:
            part, bar = rough[some], bar[some]
        near = part >= bar[:, None]
        if len(wide) > k and np.count_nonzero(near) > 4 * k * count:
            # The k-th best of the groups' maxima is no better than that of all, and nearly as good.
            groups = min(len(wide), max(FLOOR_GROUPS, 8 * k))
            even = part[:, : len(wide) - len(wide) % groups]
            tops = even.reshape(len(part), -1, groups).max(axis=1)
            kth = np.partition(tops, -k, axis=1)[:, -k] - np.float32(2 * slack)
            near = part >= np.maximum(bar, kth)[:, None]
        r, c = np.divmod(_marked(near.reshape(-1)), len(wide))  # faster than in two dimensions
        pairs = some[r], c + start, part[r, c]
        if len(r) > DENSE * rough.size:
            best = _kept(best, [scored(pairs, start, start + len(wide))], k, count)
            floor = np.maximum(floor, _kth_value(*best[::2], k, count) - slack)
            continue
        found.append(pairs)
        waiting += len(r)
        if waiting >= k * count:
            found, floor = _thinned(best, found, k, count, floor, slack)
            waiting = 0
            if len(found[0][0]) > 4 * k * count:  # ties that single precision cannot tell apart
                best, found = _kept(best, [scored(found[0])], k, count), []
                floor = np.maximum(floor, _kth_value(*best[::2], k, count) - slack)
    if found:
        found, _ = _thinned(best, found, k, count, floor, slack)
    return _kept(best, [scored(pairs) for pairs in found], k, count)


def _thinned(best, found, k, count, floor, slack):
    """Found pairs that may still be among the ``k`` best of their row, and the rows' new floors."""
    rows, cols, rough = (np.concatenate(x) for x in zip(*found, strict=True))
    kth = _kth_value(np.concatenate([best[0], rows]), np.concatenate([best[2], rough]), k, count)
    floor = np.maximum(floor, kth - 2 * slack)
    keep = rough >= floor[rows]
    return [(rows[keep], cols[keep], rough[keep])], floor


def _kth_value(rows, values, k, count):
    """The ``k``-th highest of the values of each of ``count`` rows; minus infinity if they are fewer."""
    keys = np.sort(4.0 * rows - values)  # values are cosines, so rows stay apart
    sizes = np.bincount(rows, minlength=count)
    full = np.flatnonzero(sizes >= k)
    out = np.full(count, -np.inf)
    out[full] = 4.0 * full - keys[np.cumsum(sizes)[full] - sizes[full] + k - 1]
    return out


def _marked(marks):
    """Positions of the marks. They are few, so eight are looked at together."""
    eights = len(marks) // 8
    words = np.flatnonzero(marks[: 8 * eights].view(np.uint64))
    if len(words) > eights // 8:
        return np.flatnonzero(marks)
    word, place = np.nonzero(marks[: 8 * eights].reshape(-1, 8)[words])
    return np.concatenate([8 * words[word] + place, np.flatnonzero(marks[8 * eights :]) + 8 * eights])


def _kept(best, found, k, count):
    """The ``k`` best of each of ``count`` rows, of what was kept and what was found since."""
    rows, cols, scores = (np.concatenate(x) for x in zip(best, *found, strict=True))
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    begins = np.searchsorted(rows, np.arange(count + 1))
    keep = np.arange(len(rows)) - begins[rows] < k
    return rows[keep], cols[keep], scores[keep]


def _scores(block, wide, r, c):
    """Double precision scores of the chosen pairs."""
    if len(r) > DENSE * block.shape[0] * wide.shape[0]:
        return (block @ wide.T)[r, c]
    piece = 1 << 16
    parts = [
        np.einsum("ij,ij->i", block[r[i : i + piece]], wide[c[i : i + piece]])
        for i in range(0, len(r), piece)
    ]
    return np.concatenate(parts) if parts else np.empty(0)


# Groups around pivots ---------------------------------------------------------------------------

FAN = 32  # pivots of a node of the two-level tree, so FAN * FAN groups at most
PROBE_ROWS = 8_192  # of each side, to see whether groups could be worth it
PROBES = 128  # of these sources that are compared with all targets
_MARGIN = 1e-6  # of a bound, far above the errors of angles and of rounding to DIGITS
_GROUPED = "id string, embedding array<double>, leaf int, angle double"
_PAIRS = "s_leaf int, s_parts int, t_leaf int, t_parts int, t_rows long, bound double"


@dataclass(frozen=True)
class PivotTree:
    """Unit vectors of two levels: leaves ``first[i]`` to ``first[i + 1]`` are those below top ``i``.

    Its size depends on ``FAN`` and the vector length only, not on the number of rows.
    """

    tops: np.ndarray
    leaves: np.ndarray
    first: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector, below its nearest top, and the angle to that leaf."""
        top = (vectors @ self.tops.T).argmax(axis=1)
        leaf, near = np.empty(len(vectors), np.int64), np.empty(len(vectors))
        for i in np.unique(top):
            own = np.flatnonzero(top == i)
            score = vectors[own] @ self.leaves[self.first[i] : self.first[i + 1]].T
            best = score.argmax(axis=1)
            leaf[own], near[own] = best + self.first[i], score[np.arange(len(own)), best]
        return leaf, np.arccos(np.clip(near, -1, 1))


def _directions(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows that have a direction, and their vectors scaled to length one."""
    batch = batch.filter(pc.is_valid(batch.column("embedding")))
    lists = batch.column("embedding")
    if not batch.num_rows:
        return batch, np.empty((0, 0))
    lengths = pc.min_max(pc.list_value_length(lists)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("embeddings of different lengths cannot be compared")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(batch.num_rows, -1)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    usable = np.isfinite(norms) & (norms > 0)
    return batch.filter(pa.array(usable)), vectors[usable] / norms[usable, None]


def _pivot_tree(target: DataFrame, fan: int) -> PivotTree | None:
    """Pivots are rows picked by a hash: ``fan`` of all, then ``fan`` of each group around those."""
    order = F.xxhash64("id", "embedding")
    picked = target.filter("embedding IS NOT NULL").orderBy(order).limit(fan).select("id", "embedding")
    _, tops = _unit_rows(*_columns(picked.collect()))
    if not len(tops):
        return None
    alone = PivotTree(tops, tops, np.arange(len(tops) + 1))
    below = top_by(target.mapInArrow(_nearest(alone), _GROUPED), ["leaf"], [order], fan)
    rows = below.select("leaf", "id", "embedding").collect()  # fan * fan at most
    parts = [_unit_rows(*_columns([r for r in rows if r.leaf == i]))[1] for i in range(len(tops))]
    used = [i for i, part in enumerate(parts) if len(part)]
    first = np.cumsum([0, *[len(parts[i]) for i in used]])
    return PivotTree(tops[used], np.concatenate([parts[i] for i in used]), first)


def _probed(source, target, k, min_score, sizes: tuple[int, int, int], fan=FAN) -> float:
    """At least so many rows, or nearly, would be copied by groups; from a few rows of both sides.

    It costs one pass over the targets, the groups several over both sides. Only the way of the work
    is chosen by it. Pivots are targets picked by a hash, as in the tree. Some picked sources are
    compared with all targets, and their k-th scores are no less than the floors of their lanes;
    radii of picked rows are no more than those of all. So more pairs of groups are left in the end.
    """
    rows_s, rows_t, dim = sizes
    most = min(PROBE_ROWS, max(2 * fan * fan, LANE_BYTES // (64 * dim)))
    picked = []
    for df, rows in ((source, rows_s), (target, rows_t)):
        here = F.pmod(F.xxhash64("id"), F.lit(max(1, rows // most))) == 0
        rows = df.filter(here & F.col("embedding").isNotNull()).limit(most)
        rows = rows.select(F.col("id").cast("string").alias("id"), "embedding").toArrow()
        picked.append(_unit_rows(rows["id"], rows["embedding"])[1])
    if not len(picked[0]) or not len(picked[1]):
        return 0.0
    # Rows lie in the order of their ids, so those to be pivots or probes are spread over them. A
    # group has some rows besides its pivot, or it would have no radius.
    pivots = picked[1][:: max(8, len(picked[1]) // (fan * fan))][: fan * fan]
    probes = picked[0][:: max(1, len(picked[0]) // PROBES)][:PROBES]
    tree = PivotTree(pivots[:1], pivots, np.array([0, len(pivots)]))
    (s_leaf, s_angle), (t_leaf, t_angle) = (tree.nearest(vectors) for vectors in picked)
    radius_s, radius_t = np.zeros(len(pivots)), np.zeros(len(pivots))
    np.maximum.at(radius_s, s_leaf, s_angle)
    np.maximum.at(radius_t, t_leaf, t_angle)
    count = np.bincount(t_leaf, minlength=len(pivots))
    floor = np.full(len(probes), -2.0 if min_score is None else float(min_score))
    tops = target.select("embedding").mapInArrow(_probe_scores(probes, k), "probe int, score double")
    kth = top_by(tops, ["probe"], [F.desc("score")], k).groupBy("probe").agg(
        F.count("*").alias("c"), F.min("score").alias("s")
    )
    for row in kth.filter(F.col("c") >= k).collect():  # one row per probe at most
        floor[row["probe"]] = max(floor[row["probe"]], row["s"])
    leaf, _ = tree.nearest(probes)
    angle = np.arccos(np.clip(pivots[leaf] @ pivots.T, -1, 1))
    bound = np.cos(np.maximum(0, angle - radius_s[leaf][:, None] - radius_t)) + _MARGIN
    share = ((bound >= floor[:, None]) @ count).mean() / len(picked[1])
    return share * rows_t * len(np.unique(s_leaf))


def _probe_scores(probes: np.ndarray, k: int):
    """The ``k`` best scores of each probe in each batch of targets."""

    def run(batches):
        for batch in batches:
            _, vectors = _directions(batch)
            if len(vectors) and vectors.shape[1] != probes.shape[1]:
                raise ValueError("embeddings of different lengths cannot be compared")
            best = probes @ vectors.T if len(vectors) else np.empty((len(probes), 0))
            if best.shape[1] > k:
                best = np.partition(best, -k, axis=1)[:, -k:]
            probe = np.repeat(np.arange(len(probes), dtype=np.int32), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(best.ravel())], ["probe", "score"])

    return run


def _pruned(source, target, k, min_score, digits, fan=FAN, most: int | None = None):
    """As ``topk_similar``, and the table of the cells that were compared.

    Where the cells would copy more than ``most`` rows, there is no result but None.

    By the triangle inequality of angles, no score between two groups is above the cosine of the
    pivots' angle less both radii. First each group of sources meets the groups with the highest
    bounds, which gives each of its lanes a floor: the least k-th score of its sources. Then a lane
    meets only those other groups whose bound reaches its floor or ``min_score``. Bounds, floors
    and cells are tables; the driver holds the pivots and one row per group of targets.
    """
    spark = source.sparkSession
    sides = [df.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
             for df in (source, target)]
    tree = _pivot_tree(sides[1], fan)
    if tree is None:
        return spark.createDataFrame([], schemas.SCORES), None
    lane_rows = max(1, LANE_BYTES // (8 * tree.leaves.shape[1]))
    lanes, sizes = [], []
    for own in sides:
        grouped = materialize(own.mapInArrow(_nearest(tree), _GROUPED), "groups")
        size = grouped.groupBy("leaf").agg(
            F.count("*").alias("rows"), F.max("angle").alias("radius"),
            F.ceil(F.count("*") / lane_rows).cast("int").alias("parts"),
        )
        size = materialize(size, "group-sizes")
        # All rows of an id are in one lane.
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        lanes.append(grouped.join(size.select("leaf", "parts"), "leaf").select("id", "embedding", "leaf", part.alias("part")))
        sizes.append(size)
    floor = -2.0 if min_score is None else float(min_score)
    reach = sizes[1].toArrow()  # one row per group of targets
    ranked = Window.partitionBy("s_leaf").orderBy(F.desc("bound"), "t_leaf")
    before = F.sum("t_rows").over(ranked.rowsBetween(Window.unboundedPreceding, -1))
    # The best groups until they hold some times k targets come early.
    early = F.coalesce(before, F.lit(0)) < 4 * k
    pairs = materialize(
        sizes[0].mapInArrow(_bounds(tree, reach, floor), _PAIRS).withColumn("early", early), "group-pairs"
    )
    every_part = F.explode(F.sequence(F.lit(0), F.col("s_parts") - 1)).alias("s_part")
    columns = ["s_leaf", "s_part", "t_leaf", "t_parts"]
    first = pairs.filter("early").select("*", every_part).select(*columns)
    found = materialize(_compare_cells(lanes, first, k, min_score, digits), "scores")
    floors = materialize(
        lanes[0].select("id", "leaf", "part").join(_kth(found, k), "id", "left").groupBy("leaf", "part").agg(
            F.min(F.coalesce("s", F.lit(-2.0))).alias("floor")
        ),
        "floors",
    )
    near = (F.col("s_leaf") == F.col("leaf")) & (F.col("bound") >= F.greatest(F.col("floor"), F.lit(floor)))
    rest = materialize(
        pairs.filter("NOT early").join(floors, near).select("s_leaf", F.col("part").alias("s_part"), "t_leaf", "t_parts"),
        "cells",
    )
    if most is not None and _copied(rest, sizes) > most:
        return None, first.unionByName(rest)
    more = _compare_cells(lanes, rest, k, min_score, digits)
    best = found.unionByName(more).groupBy("source", "target").agg(F.max("score").alias("score"))
    return top_by(best, ["source"], [F.desc("score"), F.asc("target")], k), first.unionByName(rest)


def _copied(cells: DataFrame, sizes: list[DataFrame]) -> float:
    """Rows that are copied to these cells, a cell itself counted as some."""
    s, t = (
        size.select(F.col("leaf").alias(f"{side}_leaf"), F.col("rows").alias(f"_{side}"), (F.col("rows") / F.col("parts")).alias(f"_{side}_lane"))
        for side, size in zip("st", sizes, strict=True)
    )
    copied = F.col("_s_lane") * F.col("t_parts") + F.col("_t") + CELL_ROWS * F.col("t_parts")
    return cells.join(s, "s_leaf").join(t, "t_leaf").agg(F.sum(copied)).first()[0] or 0.0


def _kth(found: DataFrame, k: int) -> DataFrame:
    """``id, s``: the k-th best score of the sources that have as many."""
    best = found.groupBy("source", "target").agg(F.max("score").alias("score"))
    first = top_by(best, ["source"], [F.desc("score"), F.asc("target")], k)
    kth = first.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("c"), F.min("score").alias("s"))
    return kth.filter(F.col("c") >= k).select("id", "s")


def _columns(rows) -> tuple[pa.Array, pa.Array]:
    return pa.array([r.id for r in rows], pa.string()), pa.array([r.embedding for r in rows], pa.list_(pa.float64()))


def _nearest(tree: PivotTree):
    """Leaf of each row and the angle to its pivot; rows without direction are left out."""

    def run(batches):
        for batch in batches:
            rows, vectors = _directions(batch)
            if not rows.num_rows:
                continue
            if vectors.shape[1] != tree.tops.shape[1]:
                raise ValueError("embeddings of different lengths cannot be compared")
            leaf, angle = tree.nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("embedding"), pa.array(leaf, pa.int32()), pa.array(angle)],
                ["id", "embedding", "leaf", "angle"],
            )

    return run


def _bounds(tree: PivotTree, reach: pa.Table, floor: float):
    """Pairs of a group of sources with all groups of targets whose bound is above ``floor``."""
    leaf, rows, radius, parts = (reach[c].to_numpy() for c in ("leaf", "rows", "radius", "parts"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                angle = np.arccos(np.clip(tree.leaves[leaf] @ tree.leaves[row["leaf"]], -1, 1))
                bound = np.cos(np.maximum(0, angle - radius - row["radius"])) + _MARGIN
                keep = bound > floor
                count = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, row["leaf"]), pa.int32()), pa.array(np.full(count, row["parts"]), pa.int32()),
                        pa.array(leaf[keep], pa.int32()), pa.array(parts[keep], pa.int32()),
                        pa.array(rows[keep], pa.int64()), pa.array(bound[keep]),
                    ],
                    ["s_leaf", "s_parts", "t_leaf", "t_parts", "t_rows", "bound"],
                )

    return run


def _compare_cells(lanes, cells: DataFrame, k, min_score, digits) -> DataFrame:
    """Best pairs of the wanted cells: a lane of sources against each lane of a group of targets."""
    key = ["s_leaf", "s_part", "t_leaf", "t_part"]
    opposite = F.explode(F.sequence(F.lit(0), F.col("t_parts") - 1)).alias("t_part")
    sources = lanes[0].withColumnsRenamed({"leaf": "s_leaf", "part": "s_part"}).join(cells, ["s_leaf", "s_part"])
    targets = lanes[1].withColumnsRenamed({"leaf": "t_leaf", "part": "t_part"}).join(cells, "t_leaf")
    copies = []
    for side, rows in (("s", sources.select("*", opposite)), ("t", targets)):
        names = [F.col(c).alias(f"{side}_key_{c}") for c in key]
        copy = rows.select(F.col("id").alias(f"{side}_id"), F.col("embedding").alias(f"{side}_embedding"), *names)
        copies.append(copy.groupBy(*[f"{side}_key_{c}" for c in key]))
    return copies[0].cogroup(copies[1]).applyInArrow(_cell(k, min_score, digits), schemas.SCORES)


def score_threshold(scores: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Strictly above the minimum."""
    return scores.filter(F.col("score") > minimum)


def parse_similar_json(replies: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Scores from search replies ``source, reply`` with one JSON hit per line.

    Lines that start with ``Error`` and lines that are no JSON hit are dropped.
    """
    hit = F.from_json("line", "id string, score double")
    lines = replies.select("source", F.explode(F.split("reply", "\n")).alias("line"))
    hits = (
        lines.filter(~F.startswith("line", F.lit("Error")))
        .withColumn("hit", hit)
        .select(
            "source",
            F.col("hit.id").alias("target"),
            F.coalesce("hit.score", F.lit(0.0)).alias("score"),
        )
    )
    return score_threshold(hits.filter(F.col("target").isNotNull()), minimum)
