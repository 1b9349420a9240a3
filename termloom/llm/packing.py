"""Best-fit packing of documents into training sequences, with conflicts.

Lengths, sources and duplicate clusters are all that packing needs; texts stay where they are.
Documents are dealt to parts by hash (copies of one row by their number, too), so a part is a random
sample of all sources of bounded size, and each part is packed on its own: longest first, into the fullest bin that still has room and no conflict. Bins
stand in the order of their residual room; the search starts at the successor of the length and
goes on to the next larger residual until a bin is compatible. A bin carries bitmaps of its
clusters and of its sources, one plane for each time a source may occur: a bin never holds two
documents of one cluster, nor more than ``per_source`` of one source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.rules import SPACE, WORD_BYTE

CAPACITY = 4096
PER_SOURCE = 4
PART_DOCUMENTS = 5_000
OFTEN = 64  # documents of a cluster in a part from which on it has an order of bins
COPY_ROWS = 1_000  # rows that one counted row unfolds to in a task
_PLAN = "doc_id long, piece int, pieces int, length int, bin string, position int, offset int, residual int"


class Bins:
    """Open bins in the order of residual room, then of number.

    A cluster or source that many documents of the part have gets an order of its own, of the bins
    that still take it, so a search does not walk past all those that do not.
    """

    def __init__(self, capacity: int, per_source: int, clusters: Iterable[int] = (), sources: Iterable[int] = ()):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.of_cluster: dict[int, list] = {bit: [] for bit in clusters}
        self.of_source: dict[int, list] = {bit: [] for bit in sources}
        self.room: list[int] = []
        self.count: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def fits(self, number: int, cluster: int, source: int) -> bool:
        return not (self.clusters[number] & cluster or self.sources[number][-1] & source)

    def _orders(self, number: int):
        """All orders that the bin is in, or belongs into."""
        yield self.order
        held, full = self.clusters[number], self.sources[number][-1]
        for bit, order in self.of_cluster.items():
            if not held & bit:
                yield order
        for bit, order in self.of_source.items():
            if not full & bit:
                yield order

    def place(self, length: int, cluster: int, source: int) -> tuple[int, int, int]:
        """Bin, position and offset for a document; ``cluster`` and ``source`` are single bits or 0."""
        own = [o for o in (self.of_cluster.get(cluster), self.of_source.get(source)) if o is not None]
        order = min(own, key=len, default=self.order)
        at = bisect_left(order, (length, -1))
        while at < len(order) and not self.fits(order[at][1], cluster, source):
            at += 1
        if at < len(order):
            entry = order[at]
            number = entry[1]
            for other in self._orders(number):
                other.pop(bisect_left(other, entry))
        else:
            number = len(self.room)
            self.room.append(self.capacity)
            self.count.append(0)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        offset = self.capacity - self.room[number]
        position = self.count[number]
        self.room[number] -= length
        self.count[number] += 1
        self.clusters[number] |= cluster
        for plane, held in enumerate(self.sources[number]):
            if not held & source:
                self.sources[number][plane] = held | source
                break
        if self.room[number]:
            for other in self._orders(number):
                insort(other, (self.room[number], number))
        return number, position, offset


def _frequent(bits: list[int], least: int) -> list[int]:
    return [bit for bit, n in Counter(bits).items() if bit and n > least]


def _bits(values: list, single: bool) -> list[int]:
    """A bit for each value; without ``single`` values that occur once need none."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    number: dict = {}
    return [
        0 if v is None or (counts[v] == 1 and not single) else 1 << number.setdefault(v, len(number))
        for v in values
    ]


def _pack(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        ids, lengths = rows["doc_id"], rows["length"]
        part = rows["part"][0]
        clusters, sources = _bits(rows["cluster"], False), _bits(rows["source"], True)
        # Longest first; equal lengths by cluster and number, so the plan does not depend on order.
        order = sorted(
            range(len(ids)),
            key=lambda i: (-lengths[i], rows["cluster"][i] or 0, ids[i] is None, ids[i] or 0, rows["source"][i] or ""),
        )
        bins = Bins(capacity, per_source, _frequent(clusters, OFTEN), _frequent(sources, len(ids) // 10))
        out = []
        for i in order:
            whole, rest = divmod(lengths[i], capacity)
            pieces = whole + (rest > 0)
            for piece in range(pieces):
                size = capacity if piece < whole else rest
                # Full pieces fill a bin of their own.
                number, position, offset = bins.place(size, clusters[i], sources[i])
                out.append((ids[i], piece, pieces, size, number, position, offset))
        return pa.table(
            {
                "doc_id": pa.array([r[0] for r in out], pa.int64()),
                **{
                    name: pa.array([r[j] for r in out], pa.int32())
                    for j, name in ((1, "piece"), (2, "pieces"), (3, "length"))
                },
                "bin": pa.array([f"{part}-{r[4]}" for r in out], pa.string()),
                "position": pa.array([r[5] for r in out], pa.int32()),
                "offset": pa.array([r[6] for r in out], pa.int32()),
                "residual": pa.array([bins.room[r[4]] for r in out], pa.int32()),
            }
        )

    return run


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with their part. Equal rows are counted first and dealt by their running number, so the

    copies of one row, however many, spread over all parts like any others.
    """
    counted = rows.groupBy("doc_id", "length", "source", "cluster").agg(F.count("*").alias("rows"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPY_ROWS))
    chunked = counted.select("*", F.explode(chunks).alias("chunk"))
    few = chunked.filter(F.col("rows") <= COPY_ROWS)
    # A row that would unfold to very many in one task is unfolded in several.
    many = chunked.filter(F.col("rows") > COPY_ROWS).repartition("doc_id", "length", "chunk")
    last = F.least(F.col("rows"), (F.col("chunk") + 1) * COPY_ROWS)
    copies = F.explode(F.sequence(F.col("chunk") * COPY_ROWS + 1, last)).alias("copy")
    number = F.pmod(F.xxhash64("doc_id", "length", "cluster", "copy", F.lit("pack")), F.lit(parts))
    each = few.unionByName(many).select("doc_id", "length", "source", "cluster", copies)
    return each.select("doc_id", "length", "source", "cluster", number.alias("part"))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
    part_documents: int = PART_DOCUMENTS, text: str = "text", id: str = "doc_id", source: str = "source",
    cluster: str | None = None,
) -> DataFrame:
    """``doc_id, piece, pieces, length, bin, position, offset, residual``: where each piece goes.

    A length counts words at ASCII white space and one end of document, so a null or empty text
    has length 1. A text longer than a bin is cut into full pieces and a rest, none is dropped.
    A cluster is the documents with one and the same lower-cased sequence of words, or those with
    one value in the column ``cluster``, such as the component of near duplicates; a null there is
    no cluster. A null source conflicts with nothing; rows without a number, and repeated rows, are
    packed like others and spread over all parts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    if cluster is None:
        key = F.when(body.rlike(WORD_BYTE), F.xxhash64(F.trim(F.regexp_replace(F.lower(body), SPACE, " "))))
    else:
        key = F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster)))
    rows = docs.select(
        F.col(id).alias("doc_id"), (F.size(words) + 1).alias("length"),
        F.col(source).cast("string").alias("source"), key.alias("cluster"),
    )
    parts = max(1, -(-docs.count() // part_documents))
    return _dealt(rows, parts).groupBy("part").applyInArrow(_pack(capacity, per_source), _PLAN)
