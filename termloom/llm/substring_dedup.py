"""Removal of passages that a document with a smaller number has, found in compressed indexes.

Each window of 13 words belongs to its anchor, the six-word run in it with the least hash. Equal
windows have equal anchors, so a shard that holds all stretches of text around some anchors sees
every copy of their windows. Anchors that only one document has are left out first, by a bitmap of
fixed size (a false hit costs work, not correctness). A shard builds an FM-index over its distinct
stretches, and every stretch is streamed through it backwards: the matching statistics of at least
13 words give intervals of suffixes, and an interval's smallest document owns the window.

Only distinct stretches with their smallest document go to the shards, so a passage that a third of
all documents share is one row per task there. A phrase that stands in other words everywhere gives
its anchor many distinct stretches: such an anchor is hot, each of its windows is a stretch, and
these go to shards by their own words, where equal windows still meet. What the shards find is
joined back by stretch, as a plain join that Spark may split where it is skewed. Shared and hot
anchors travel to the tasks as bitmaps of fixed size, never as lists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.fm_index import FMIndex
from termloom.llm.text_arrays import PLAIN, Words, pieces, ranges, text_buffer, windows, words
from termloom.session import materialize

WINDOW, ANCHOR = 13, 6
_RUN = 16  # windows of one stretch at most
_BITS, _CHUNK = 28, 20  # of the bitmap, and of a part of it
_STRETCHES = 60_000  # of a shard
_HOT = 15_000  # distinct stretches of an anchor that is spread over shards
_BATCH = 4 << 20
_COPIES = "anchor long, digest long, text binary, low long, high long, spread long"
_OWNERS = "anchor long, digest long, owners array<long>"
_PLACES = "anchor long, digest long, doc_id long, at int, n int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Stretches:
    """Runs of windows with one anchor: anchor, first word, number of windows and document."""

    def __init__(self, found: Words, window: int, hot: np.ndarray | None = None, run: int = _RUN):
        digest, first = found.hashes(), found.first
        grams = windows(digest, ANCHOR)
        span = window - ANCHOR + 1
        least, reach = grams, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
            reach += step
        n = max(0, len(digest) - window + 1)
        least = least[:n]
        doc = np.searchsorted(first, np.arange(n), "right") - 1
        whole = np.flatnonzero(np.arange(n) + window <= first[doc + 1]) if n else np.zeros(0, np.int64)
        new = np.ones(len(whole), bool)
        if len(whole):
            new[1:] = (
                (least[whole][1:] != least[whole][:-1])
                | (whole[1:] != whole[:-1] + 1)
                | (doc[whole][1:] != doc[whole][:-1])
            )
            begin = np.flatnonzero(new)
            new[(np.arange(len(whole)) - np.repeat(begin, np.diff(np.append(begin, len(whole))))) % run == 0] = True
            if hot is not None:
                new |= _passes(hot, least[whole])
        begin = np.flatnonzero(new)
        self.count = np.diff(np.append(begin, len(whole)))
        self.at = whole[begin]
        self.doc = doc[self.at] if n else self.at
        self.anchor = least[self.at] if n else np.zeros(0, np.uint64)
        self.size = self.count + window - 1
        total = np.zeros(len(self.at), np.uint64)
        for j in range(int(self.size.max()) if len(self.at) else 0):
            inside = j < self.size
            total[inside] *= np.uint64(0x9FB21C651E98DF25)
            total[inside] += digest[self.at[inside] + j]
        self.digest = total ^ (self.count.astype(np.uint64) << np.uint64(58))

    def only(self, keep: np.ndarray) -> Stretches:
        for name in ("count", "at", "doc", "anchor", "size", "digest"):
            setattr(self, name, getattr(self, name)[keep])
        return self


def _found(part, window: int, hot: np.ndarray | None = None):
    found = words(*text_buffer(part.column("text")), PLAIN, lower=False)
    return found, Stretches(found, window, hot)


def _heads(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where other values begin in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _anchors(window: int):
    """Anchors of each piece: in how many of its documents, and in how many distinct stretches."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, _BATCH):
                _, own = _found(part, window)
                counts = []
                for other in (own.doc, own.digest):
                    order, head = _heads(own.anchor, other)
                    anchor, n = np.unique(own.anchor[order[head]], return_counts=True)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])],
                    ["anchor", "n", "stretches"],
                )

    return run


def _digests(often, window: int):
    """Distinct stretches of some anchors in each piece."""

    def run(batches):
        some = often.value
        for batch in batches:
            for part in pieces(batch, _BATCH):
                _, own = _found(part, window)
                own.only(_passes(some, own.anchor))
                order, head = _heads(own.anchor, own.digest)
                pick = order[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.anchor[pick].view(np.int64)), pa.array(own.digest[pick].view(np.int64))],
                    ["anchor", "digest"],
                )

    return run


def _hot(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame | None:
    """Anchors with more than about ``_HOT`` distinct stretches, or None.

    In how many documents they stand does not matter: a phrase that few long documents repeat among
    other words has as many. A passage that many documents share whole has few and is not hot.
    """
    often = shared.filter(F.col("stretches") > _HOT).select("anchor")
    if often.isEmpty():
        return None
    data = docs.sparkSession.sparkContext.broadcast(_bits(often))
    seen = docs.select("text").mapInArrow(_digests(data, window), "anchor long, digest long")
    counts = seen.groupBy("anchor").agg(F.approx_count_distinct("digest").alias("n"))
    hot = materialize(counts.filter(F.col("n") > _HOT).select("anchor"), "hot-anchors")
    return None if hot.isEmpty() else hot


def _bits(anchors: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of anchors: 32 MB, whatever their number.

    An anchor that passes without being there is treated as those that are, in every task alike.
    """
    place = F.col("anchor").bitwiseAND(F.lit((1 << _BITS) - 1))
    parts = (
        anchors.select(
            F.shiftright(place, _CHUNK).alias("chunk"),
            place.bitwiseAND(F.lit((1 << _CHUNK) - 1)).alias("bit"),
        )
        .groupBy("chunk")
        .applyInArrow(_bitmap, "chunk long, bits binary")
    )
    size = 1 << (_CHUNK - 3)
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        bits[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits


def _bitmap(table: pa.Table) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    bits = np.zeros(1 << _CHUNK, bool)
    bits[table.column("bit").to_numpy()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([packed], pa.binary())})


def _passes(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    place = (anchor & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _spread(hot, anchor: np.ndarray) -> np.ndarray:
    return _passes(hot.value, anchor) if hot is not None else np.zeros(len(anchor), bool)


def _copies(bitmap, hot, window: int):
    """Distinct stretches of a task with their words and the range of their documents."""

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            for part in pieces(batch, _BATCH):
                found, own = _found(part, window, hot and hot.value)
                own.only(_passes(bits, own.anchor))
                if not len(own.at):
                    continue
                number = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[own.doc]
                order = np.lexsort((number, own.digest, own.anchor))
                same = np.ones(len(order), bool)
                same[1:] = (own.digest[order][1:] != own.digest[order][:-1]) | (
                    own.anchor[order][1:] != own.anchor[order][:-1]
                )
                head = np.flatnonzero(same)
                last = np.append(head[1:], len(order)) - 1
                pick = order[head]
                joined, edges = kept_bytes(found, np.ones(len(found.starts), bool))
                borders = zip(edges[own.at[pick]], edges[own.at[pick] + own.size[pick]], strict=True)
                texts = [joined[a : b - 1].tobytes() for a, b in borders]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.anchor[pick].view(np.int64)), pa.array(own.digest[pick].view(np.int64)),
                        pa.array(texts, pa.binary()), pa.array(number[pick]), pa.array(number[order[last]]),
                        pa.array(np.where(_spread(hot, own.anchor[pick]), own.digest[pick], np.uint64(0)).view(np.int64)),
                    ],
                    ["anchor", "digest", "text", "low", "high", "spread"],
                )

    return run


def _shard(window: int):
    """Owner of each window of each stretch, from an index over the shard's stretches."""

    def run(table: pa.Table) -> pa.Table:
        anchor, digest, low, high = (
            table.column(c).to_numpy() for c in ("anchor", "digest", "low", "high")
        )
        order = np.lexsort((low, digest, anchor))
        head = np.ones(len(order), bool)
        head[1:] = (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        begin = np.flatnonzero(head)
        pick = order[begin]
        low, high = low[pick], np.maximum.reduceat(high[order], begin)
        numbers: dict[bytes, int] = {}
        runs, sizes = [], []
        for text in table.column("text").take(pa.array(pick)).to_pylist():
            own = [numbers.setdefault(w, len(numbers) + 1) for w in text.split(b" ")]
            sizes.append(len(own))
            runs.append(0)
            runs.extend(own)
        text, sizes = np.array([*runs, 0], np.int64), np.array(sizes, np.int64)
        starts = np.cumsum(sizes + 1) - sizes
        index = FMIndex(text, len(numbers) + 1, window)
        a, b = index.matches(text, starts, sizes, window)
        owner = np.zeros(len(text), np.int64)
        owner[ranges(starts, sizes)] = np.repeat(low, sizes)
        at = ranges(starts, sizes - window + 1)
        edges, back = np.unique(a[at], return_inverse=True)
        ends = np.zeros(len(edges), np.int64)
        ends[back] = b[at]
        by_place = np.append(owner[index.places], np.iinfo(np.int64).max)
        best = np.minimum.reduceat(by_place, np.stack([edges, ends], 1).reshape(-1))[::2]
        least = best[back]
        first = np.cumsum(sizes - window + 1) - (sizes - window + 1)
        lowest, highest = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
        wanted = np.flatnonzero((high > low) | (lowest < low))
        one = lowest == highest
        owners = [
            [int(lowest[i])] if one[i] else least[first[i] : first[i] + sizes[i] - window + 1].tolist()
            for i in wanted
        ]
        return pa.table(
            {
                "anchor": anchor[pick[wanted]],
                "digest": digest[pick[wanted]],
                "owners": pa.array(owners, pa.list_(pa.int64())),
            }
        )

    return run


def _occurrences(bitmap, hot, window: int):
    """Where each stretch that may be shared stands."""

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            for part in pieces(batch, _BATCH):
                found, own = _found(part, window, hot and hot.value)
                own.only(_passes(bits, own.anchor))
                number = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[own.doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.anchor.view(np.int64)), pa.array(own.digest.view(np.int64)),
                        pa.array(number), pa.array((own.at - found.first[own.doc]).astype(np.int32)),
                        pa.array(own.count.astype(np.int32)),
                    ],
                    ["anchor", "digest", "doc_id", "at", "n"],
                )

    return run


def _cut(window: int):
    """Kept words of each document: their number and the digest of their text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, _BATCH):
                found = words(*text_buffer(part.column("text")), PLAIN, lower=False)
                gone = np.zeros(len(found.starts) + 1, np.int64)
                spans = part.column("spans")
                filled = spans.fill_null([]) if spans.null_count else spans
                each = filled.flatten()
                count = np.diff(filled.offsets.to_numpy())
                at = np.repeat(found.first[:-1], count) + each.field("at").to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + each.field("n").to_numpy() + window - 1, -1)
                keep = np.cumsum(gone[:-1]) == 0
                out, edges = kept_bytes(found, keep)
                total = np.concatenate([[0], np.cumsum(keep)])
                size = total[found.first[1:]] - total[found.first[:-1]]
                n = np.diff(found.first)
                view = memoryview(out)
                hexes = [
                    hashlib.sha256(view[edges[total[a]] : max(edges[total[b]] - 1, edges[total[a]])]).hexdigest()
                    for a, b in zip(found.first[:-1], found.first[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(n - size), pa.array(hexes, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def kept_bytes(found: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words, each with a blank behind it, and where each begins."""
    starts = found.starts[keep]
    sizes = found.ends[keep] - starts
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(edges[-1], 0x20, np.uint8)
    out[ranges(edges[:-1], sizes)] = found.data[ranges(starts, sizes)]
    return out, edges


def _in_shards(docs: DataFrame, shared: DataFrame, bitmap, hot_ones: DataFrame | None, hot, window: int) -> DataFrame:
    """The distinct stretches of each task with the number of their shard."""
    copies = shared.agg(F.sum("stretches")).first()[0] or 0
    if hot_ones is not None:  # a stretch has up to as many windows as a window has runs of an anchor's size
        copies += (window - ANCHOR) * shared.join(hot_ones, "anchor").agg(F.sum("stretches")).first()[0]
    shards = max(1, -(-copies // _STRETCHES))
    return (
        docs.select("doc_id", "text")
        .mapInArrow(_copies(bitmap, hot, window), _COPIES)
        .withColumn("shard", F.pmod(F.xxhash64("anchor", "spread"), F.lit(shards)))
        .drop("spread")
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, at, n``: runs of ``n`` windows from word ``at`` on that a smaller document has."""
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = docs.select("text").mapInArrow(_anchors(window), "anchor long, n long, stretches long")
    shared = materialize(
        anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("stretches").alias("stretches")).filter("n > 1"),
        "anchors",
    )
    send = docs.sparkSession.sparkContext.broadcast
    bitmap = send(_bits(shared))
    hot_ones = _hot(docs, shared, window)
    hot = None if hot_ones is None else send(_bits(hot_ones))
    copies = _in_shards(docs, shared, bitmap, hot_ones, hot, window)
    owners = materialize(copies.groupBy("shard").applyInArrow(_shard(window), _OWNERS), "owners")
    places = docs.select("doc_id", "text").mapInArrow(_occurrences(bitmap, hot, window), _PLACES)
    found = places.join(owners, ["anchor", "digest"]).select(
        "doc_id", "at", "n", F.transform("owners", lambda o: o < F.col("doc_id")).alias("gone")
    )
    all_, some = F.col("gone")[0], F.size("gone") > 1
    whole = found.filter(~some & all_).select("doc_id", "at", "n")
    single = found.filter(some).select("doc_id", "at", F.posexplode("gone").alias("i", "hit")).filter("hit")
    return whole.unionByName(
        single.select("doc_id", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document without repeated passages.

    A word goes if a window of ``window`` words around it also starts in a document with a smaller
    number; windows are judged on the input. Words are runs of bytes other than ASCII white space.
    A null text has no words, a text shorter than a window loses none, repeats inside one document
    stay, and a row without a number neither loses words nor takes them from others. Rows that
    share a number are one document and must have one text.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(docs, window).groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "n")).alias("spans")
    )
    return docs.join(spans, "doc_id", "left").mapInArrow(_cut(window), _RESULT)
