"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i of the first ``BINS`` rounds every element of the set
is thrown into a random bin with a random value above i; in the later rounds it goes to bin
i - BINS. A bin keeps its least value, and rounds end as soon as every bin is filled, so large sets
need one round, small ones a few, and every coordinate is filled at the end. Two sets agree in a
coordinate with probability equal to their Jaccard similarity, with concentration as for
independent coordinates.

Documents with one and the same set form a class first; from then on only the smallest document of
a class is worked with. Classes that agree in a band of ``ROWS`` coordinates are candidates.
A bucket compares its members with one pivot, and only members that the links found so far do
not connect are compared further, so a group of n copies costs a few times n comparisons. Members that
cannot be linked with anybody, because too much of their set is theirs alone, are taken out before,
and the rest is compared in blocks of sets, as products of matrices. Every link is confirmed on the
full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import smallest_reachable
from termloom.llm.text_arrays import PLAIN, mix, pieces, ranges, text_buffer, windows, words
from termloom.session import materialize, materialize_counted

SHINGLE = 5
BINS, ROWS = 96, 4  # at similarity 0.85 a pair shares no band with probability 2e-8
LEAST = 85  # percent
BLOCK = 1_500_000  # shingles of the sets that a task compares with as many others
_ROWS = 512  # sets of a block that are compared at a time
_BITS = 24  # of the bitmap of wanted documents
_SMALL = 256  # shingles that a smaller set counts for in a block, so that a block has few sets too
_COMMON = 12  # sets from which on an element is counted by a product
_BATCH = 1 << 19  # bytes of text at a time; fingerprints and sketches take many times as much
_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
_SET = "rep long, shingles binary"


def shingle_sets(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin.

    A text with fewer words than a shingle has its whole sequence as one.
    """
    found = words(*text_buffer(column), PLAIN, lower=True)
    digest, first = found.hashes(), found.first
    count = np.diff(first)
    inner = windows(digest, size)
    owner = np.repeat(np.arange(len(count)), count)[: len(inner)]
    whole = np.arange(len(inner)) + size <= first[owner + 1]
    values, owner = inner[whole], owner[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    extra = [windows(digest[first[i] : first[i + 1]], int(count[i]))[0] for i in short]
    values = np.concatenate([values, np.array(extra, np.uint64)])
    owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def sketches(values: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` filled coordinates for each set; rows of empty sets mean nothing."""
    n = len(first) - 1
    out = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    open_sets = np.flatnonzero(np.diff(first))
    shift = np.uint64(55)  # the round goes above the value
    for i in range(2 * bins):
        if not len(open_sets):
            break
        sizes = first[open_sets + 1] - first[open_sets]
        if len(open_sets) == n:
            own = values
        else:
            own = values[ranges(first[open_sets], sizes)]
        drawn = mix(own, i + 1)
        rank = (np.uint64(i) << shift) + (drawn >> np.uint64(64 - 55))
        row = np.repeat(open_sets, sizes)
        if i < bins:
            column = (mix(drawn, 77) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        else:
            column = np.full(len(own), i - bins)
        np.minimum.at(out.reshape(-1), row * bins + column.astype(np.int64), rank)
        done = (out[open_sets] != np.iinfo(np.uint64).max).all(axis=1)
        open_sets = open_sets[~done]
    return out


def _sketch(batches):
    for batch in batches:
        for part in pieces(batch, _BATCH):
            values, first = shingle_sets(part.column("text"))
            sizes = np.diff(first)
            table = sketches(values, first)
            keys = np.zeros((len(sizes), BINS // ROWS), np.uint64)
            for j in range(ROWS):
                keys = mix(keys + table[:, j::ROWS], 5)
            keys = mix(keys + np.arange(BINS // ROWS, dtype=np.uint64), 6)
            sums = []
            for seed in (11, 12):  # two independent digests of the set
                total = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(mix(values, seed), out=total[1:])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            edges = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (BINS // ROWS))
            bands = pa.ListArray.from_arrays(edges, pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), *map(pa.array, sums), bands],
                ["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def _sets(batches):
    for batch in batches:
        for part in pieces(batch, _BATCH):
            values, first = shingle_sets(part.column("text"))
            runs = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(runs, pa.binary())], ["rep", "shingles"]
            )


def _elements(batches):
    for batch in batches:
        for part in pieces(batch, _BATCH):
            values, first = shingle_sets(part.column("text"))
            rep = np.repeat(part.column("doc_id").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(values.view(np.int64))], ["rep", "shingle"])


def _confirm(least: int):
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= least * (len(p) + len(q) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return run


def _of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """The documents whose number is in ``ends``.

    A bitmap of fixed size drops nearly all others before the join, so their texts do not move; a
    false hit goes in the join. Both are joins of Spark's, so texts go to Python once, for their sets.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _BITS))
    bit = F.expr("shiftleft(1L, int(pmod(xxhash64(doc_id), 64)))")
    # At most 2^18 words of 64 bits are broadcast, whatever the number of documents.
    bitmap = ends.select(F.shiftright(place, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    marked = (F.shiftright(place, 6) == F.col("w")) & (F.col("bits").bitwiseAND(bit) != 0)
    near = docs.select("doc_id", "text").join(F.broadcast(bitmap), marked, "left_semi")
    return near.join(ends, "doc_id", "left_semi")


def _links(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The pairs ``a, b`` of document numbers that are links."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialize(_of(docs, ends).mapInArrow(_sets, _SET), "sets")
    right = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    both = right.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(least), "a long, b long")


def _fits(least: int):
    """Pairs that sizes and shared shingles do not rule out."""
    shared = F.least("c", "d")
    return 100 * shared >= least * (F.col("n") + F.col("m") - shared)


def near_duplicates(docs: DataFrame, least: int = LEAST, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document.

    A document's set holds its distinct runs of five lower-cased words; with fewer words the whole
    sequence. Two documents are linked if 100 * intersection >= ``least`` * union; a component is
    named by its smallest document, which alone is kept. Documents without words (or null) are
    linked with nothing. A row without an id is a component of its own, without a name, and kept;
    rows that share an id are one document and must have one text.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.filter("doc_id IS NOT NULL")
    drawn = materialize(docs.mapInArrow(_sketch, _SKETCH), "sketches")
    full = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        full.groupBy("d1", "d2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    spread = materialize(
        classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n")), "bands"
    )
    sizes = spread.groupBy("key").agg(F.count("*").alias("members"))
    shared = materialize(sizes.filter("members > 1"), "buckets")
    # A member's place in its bucket, from 0 to the number of members, by hash.
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("members")
    members, count = materialize_counted(
        spread.join(shared, "key").select("key", "rep", "n", F.col("n").alias("c"), "members", place.alias("place")), "members"
    )
    roots = _connected(members, count, known, least)
    named = classes.select("d1", "d2", "n_shingles", "rep").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left"
    )
    names = named.select("d1", "d2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    found = drawn.select("doc_id", "n_shingles", "d1", "d2").join(
        names, ["d1", "d2", "n_shingles"], "left"
    )
    alone = F.col("doc_id").isNull() | F.col("root").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("root"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _connected(members: DataFrame, count: int, docs: DataFrame, least: int) -> DataFrame:
    """``node, root`` of all links between members of one bucket.

    First a bucket's members are compared with the one whose place comes first; that finishes pairs and connects most of a large group. Buckets that are not connected then
    are finished in blocks, without those members that no open pair can link.
    """
    # The same few members come first in most buckets of a group, so its pairs are few.
    first = members.groupBy("key").agg(F.min(F.struct("place", "rep", "n", "c")).alias("v"))
    pivots = first.select(
        "key", F.col("v.rep").alias("p"), F.col("v.n").alias("m"), F.col("v.c").alias("d")
    )
    pairs = (
        members.join(pivots, "key")
        .filter((F.col("rep") != F.col("p")) & _fits(least))
        .select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
        .distinct()
    )
    links = materialize(_links(materialize(pairs, "pairs"), docs, least), "links")
    roots = smallest_reachable(links)
    active = _open(members, roots)
    if active is None:
        return roots
    left = _open(_linkable(active, docs, least), roots)
    if left is None:
        return roots
    more, linked = materialize_counted(_in_blocks(left, docs, least), "links")
    return smallest_reachable(links.unionByName(more)) if linked else roots


def _open(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Members of the buckets that are neither connected nor finished, or None."""
    # Of two members one was the pivot.
    labelled = (
        members.filter(F.col("members") > 2)
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("key", "rep", "n", "c", "members", "place", F.coalesce("root", "rep").alias("root"))
    )
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    keys = mixed.filter("lo < hi").select("key")
    found, left = materialize_counted(labelled.join(keys, "key", "left_semi"), "active")
    return found if left else None


def _in_blocks(active: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Links ``a, b`` that connect all members of open buckets that are similar enough.

    Buckets that share members form clusters. A cluster is cut into blocks of about ``BLOCK``
    shingles, a small set counting for ``_SMALL``, and a task gets the sets of two blocks, or those of several small clusters. It counts
    all intersections as a matrix and returns a spanning forest of its links, so neither pairs
    nor a whole large group are ever rows or one task.
    """
    hubs = active.groupBy("key").agg(F.min("rep").alias("hub"))
    stars = active.join(hubs, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    clusters = smallest_reachable(stars.filter("a <> b"))
    weight = active.select(F.col("rep").alias("node"), F.greatest("n", F.lit(_SMALL)).alias("n")).distinct()
    sizes = materialize(
        clusters.join(weight, "node").groupBy("root").agg(F.sum("n").alias("size")), "clusters"
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total // BLOCK))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (
        clusters.join(sizes, "root")
        .withColumn("blocks", blocks)
        .select(
            F.col("node").alias("rep"), "blocks", own.alias("own"),
            # Small clusters share a task; a large one has tasks of its own.
            F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("cell"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        )
        .select("rep", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    ends = clusters.select(F.col("node").alias("doc_id"))
    sets = _of(docs, ends).dropDuplicates(["doc_id"]).mapInArrow(_sets, _SET)
    return (
        materialize(sets, "sets").join(placed, "rep")
        .groupBy("cell", "lo", "hi")
        .applyInArrow(_forest(least), "a long, b long")
    )


def _forest(least: int):
    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        own = table.column("own").to_numpy()
        first, second = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets], np.int64)
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        index = Elements(sets)
        roots = np.arange(len(rep))
        for low in range(0, len(left), _ROWS):
            some = left[low : low + _ROWS]
            shared = index.intersections(some, right)
            union = sizes[some][:, None] + sizes[right][None, :] - shared
            i, j = np.nonzero(100 * shared >= least * union)
            roots = _merged(roots, some[i], right[j])
        linked = np.flatnonzero(roots != np.arange(len(rep)))
        p, q = rep[roots[linked]], rep[linked]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return run


def _merged(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component, with the links ``a, b`` added."""
    while True:
        before = roots
        roots = before.copy()
        # A link ties the components of its ends, so their names take part.
        for x, y in ((a, b), (b, a)):
            np.minimum.at(roots, before[x], before[y])
            np.minimum.at(roots, x, before[y])
        roots = roots[roots]
        if (roots == before).all():
            return roots


class Elements:
    """Which sets have each element, for counting intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = len(sets)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        self.head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else order
        self.counts = np.diff(np.append(self.head, len(values)))

    def intersections(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the ``left`` sets with the ``right`` ones, but for a set
        with itself.

        Elements that many sets have are counted by a product of matrices, the others pair by pair.
        """
        out = np.zeros((len(left), len(right)), np.int32)
        row, column = np.full(self.size, -1), np.full(self.size, -1)
        row[left], column[right] = np.arange(len(left)), np.arange(len(right))
        common = np.flatnonzero(self.counts >= _COMMON)
        for low in range(0, len(common), 1024):
            some = common[low : low + 1024]
            at = ranges(self.head[some], self.counts[some])
            have = np.zeros((self.size, len(some)), np.float32)
            have[self.owner[at], np.repeat(np.arange(len(some)), self.counts[some])] = 1
            out += (have[left] @ have[right].T).astype(np.int32)
        for size in range(2, min(_COMMON, int(self.counts.max(initial=0)) + 1)):
            some = self.head[self.counts == size]
            for p in range(size):
                x = row[self.owner[some + p]]
                mine = np.flatnonzero(x >= 0)
                for q in range(size) if len(mine) else ():
                    y = column[self.owner[some[mine] + q]]
                    both = y >= 0
                    np.add.at(out, (x[mine][both], y[both]), 1)
        return out


def _linkable(active: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The members that an open bucket can still link, with ``c``, how much of a set is shared at all.

    Whoever could be linked is a member of an open bucket. So an intersection has only shingles
    that another open member has too, ``c`` of them, and the other set has no fewer shingles than
    the smallest of the bucket; if even that gives too low a similarity, the member goes.
    """
    own = active.select(F.col("rep").alias("doc_id")).distinct()
    spread = _of(docs, own).dropDuplicates(["doc_id"]).mapInArrow(
        _elements, "rep long, shingle long"
    )
    single = spread.groupBy("shingle").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).filter("k = 1")
    alone = single.groupBy("rep").agg(F.count("*").alias("u"))
    floor = active.groupBy("key").agg(F.min("n").alias("m"))
    known = active.join(floor, "key").join(alone, "rep", "left")
    known = known.withColumn("c", F.col("n") - F.coalesce("u", F.lit(0)))
    union = F.when(F.col("m") >= F.col("c"), F.col("n") + F.col("m") - F.col("c")).otherwise(F.col("n"))
    left = known.filter(100 * F.col("c") >= least * union)
    return materialize(left.select("key", "rep", "n", "c", "members", "place"), "members")


def drop_near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One document of each component, with its own columns; rows without an id stay."""
    gone = near_duplicates(docs, least).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
