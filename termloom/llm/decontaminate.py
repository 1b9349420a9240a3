"""Benchmark decontamination: prefix-filtered join of item windows with whole documents.

A window is contained in a document only if each of its two-word shingles is, so the shingle that
the corpus has least often is a sufficient prefix of length one. Shingles are counted over all
documents first. A document position that holds a window's rarest shingle proposes one alignment;
it has to lie inside the document (length and position), and then every word is compared.

The windows travel to the tasks in blocks of at most ``BLOCK_WORDS`` words, whatever the size of
the benchmark: a larger one takes more passes over the documents, not more memory. Documents are
neither shuffled nor joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.sharing import share, shared
from termloom.llm.text_arrays import ALPHANUMERIC, mix, pieces, ranges, text_buffer, text_of, windows, words
from termloom.session import materialize

WINDOW = 10
BLOCK_WORDS = 1_000_000
_SEGMENT = 1_000  # item words that travel together
_BATCH = 1 << 19  # bytes of text at a time; fingerprints take some twenty times as much
_PASSES = 4  # blocks between two written tables

_CUTS = "item string, digest binary, n int"
_COUNTS = "shingle long, n long"


def _hashed(column) -> tuple[np.ndarray, np.ndarray]:
    found = words(*text_buffer(column), ALPHANUMERIC, lower=True)
    return found.hashes(), found.first


def _cuts(size: int):
    """Runs of item words that overlap by one window less a word."""

    def run(batches):
        for batch in batches:
            names, runs, counts = [], [], []
            digest, first = _hashed(batch.column("text"))
            for i, name in enumerate(batch.column("item").to_pylist()):
                own = digest[first[i] : first[i + 1]]
                for low in range(0, max(1, len(own) - size + 1), _SEGMENT) if len(own) else ():
                    cut = own[low : low + _SEGMENT + size - 1]
                    names.append(name)
                    runs.append(cut.tobytes())
                    counts.append(len(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(runs, pa.binary()), pa.array(counts, pa.int32())],
                ["item", "digest", "n"],
            )

    return run


class Block:
    """Distinct windows of some items, and the index of their rarest shingles."""

    def __init__(self, rows: list, size: int):
        names = sorted({r[0] for r in rows}, key=lambda name: (name is not None, name))
        place = {name: i for i, name in enumerate(names)}
        seen: dict[bytes, int] = {}
        owners = []
        for name, digest, n in rows:
            for low in range(max(1, n - size + 1)):
                key = digest[8 * low : 8 * min(n, low + size)]
                owners.append((seen.setdefault(key, len(seen)), place[name]))
        self.names = names
        self.lengths = np.array([len(k) // 8 for k in seen], np.int64)
        self.values = np.zeros((len(seen), size), np.uint64)
        for i, key in enumerate(seen):
            self.values[i, : len(key) // 8] = np.frombuffer(key, np.uint64)
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.owner_first = np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1))
        self.owners = pairs[:, 1]
        # Shingles of each window; a window of one word has that word alone.
        self.shingles = np.zeros((len(seen), max(1, size - 1)), np.uint64)
        for j in range(size - 1):
            two = self.values[:, j : j + 2]
            code = two[:, 0] * np.uint64(0xD1342543DE82EF95) + two[:, 1]
            self.shingles[:, j] = mix(code, 2)
        single = self.lengths == 1
        self.single = bool(single.any())
        self.shingles[single, 0] = mix(self.values[single, 0], 1)
        self.has = np.arange(self.shingles.shape[1]) < np.maximum(1, self.lengths - 1)[:, None]

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.shingles[self.has])

    def anchor(self, known: np.ndarray, counts: np.ndarray) -> Block:
        """Pick each window's rarest shingle; ``counts`` are those of the ``known`` shingles."""
        if not len(self.lengths):
            self.keys, self.key_first = known[:0], np.zeros(1, np.int64)
            return self
        rarity = counts[np.searchsorted(known, self.shingles).clip(0, len(known) - 1)]
        rarity = np.where(self.has, rarity, np.iinfo(np.int64).max)
        at = rarity.argmin(axis=1)
        anchors = self.shingles[np.arange(len(at)), at]
        order = np.argsort(anchors, kind="stable")
        self.keys, self.key_first = np.unique(anchors[order], return_index=True)
        self.key_first = np.append(self.key_first, len(order))
        self.window, self.offset = order, at[order]
        del self.shingles, self.has
        return self

    def find(self, digest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and window number of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(digest):
            return none, none, none
        places, keys = [none], [none]
        forms = [windows(digest, 2)] + ([mix(digest, 1)] if self.single else [])
        for shingles in forms:
            at, key = member(shingles, self.keys)
            places.append(at)
            keys.append(key)
        at, key = np.concatenate(places), np.concatenate(keys)
        count = self.key_first[key + 1] - self.key_first[key]
        entry = ranges(self.key_first[key], count)
        window, begin = self.window[entry], np.repeat(at, count) - self.offset[entry]
        doc = np.searchsorted(first, np.repeat(at, count), "right") - 1
        fits = (begin >= first[doc]) & (begin + self.lengths[window] <= first[doc + 1])
        window, begin, doc = window[fits], begin[fits], doc[fits]
        for j in range(self.values.shape[1]):
            there = np.minimum(begin + j, len(digest) - 1)
            same = (j >= self.lengths[window]) | (digest[there] == self.values[window, j])
            window, begin, doc = window[same], begin[same], doc[same]
        return doc, begin, window


def member(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are among the sorted keys, and which key each is."""
    bits = np.uint64((1 << 20) - 1)
    seen = np.zeros(1 << 20, bool)
    seen[(keys & bits).astype(np.int64)] = True
    at = np.flatnonzero(seen[(values & bits).astype(np.int64)])
    key = np.searchsorted(keys, values[at])
    right = key < len(keys)
    at, key = at[right], key[right]
    right = keys[key] == values[at]
    return at[right], key[right]


def _count(known):
    """How often each known shingle occurs in the documents of a task."""

    def run(batches):
        keys = known.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in pieces(batch, _BATCH):
                digest, first = _hashed(part.column("text"))
                for shingles in (windows(digest, 2), mix(digest, 1)):
                    total += np.bincount(member(shingles, keys)[1], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"]
        )

    return run


def _mark(block, text):
    """Add the occurrences of one block's windows to what earlier blocks have found."""

    def run(batches):
        index = shared(block)
        names = pa.array(index.names, pa.string())
        for batch in batches:
            for part in pieces(batch, _BATCH, text):
                digest, first = _hashed(text_of(part, text))
                doc, begin, window = index.find(digest, first)
                step = np.zeros(len(digest) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + index.lengths[window], -1)
                cover = np.cumsum(step[:-1]) > 0
                own = {}
                if len(doc):
                    count = index.owner_first[window + 1] - index.owner_first[window]
                    item = index.owners[ranges(index.owner_first[window], count)]
                    pairs = np.unique(np.stack([np.repeat(doc, count), item], 1), axis=0)
                    for i, k in pairs.tolist():
                        own.setdefault(i, []).append(names[k].as_py())
                covers, items, hits = [], [], []
                old_covers, old_items = part.column("cover"), part.column("items")
                for i in range(part.num_rows):
                    before, bits = old_covers[i].as_py(), cover[first[i] : first[i + 1]]
                    if before:
                        bits = bits | np.unpackbits(np.frombuffer(before, np.uint8), count=len(bits)).astype(bool)
                    hits.append(int(bits.sum()))
                    covers.append(np.packbits(bits).tobytes() if hits[-1] else b"")
                    found = own.get(i, [])
                    every = {*old_items[i].as_py(), *found}
                    items.append(sorted(every, key=lambda name: (name is not None, name)))
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {
                    "cover": pa.array(covers, pa.binary()),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "n_words": pa.array(np.diff(first)),
                    "n_hit": pa.array(hits, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def annotate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``row`` (the document's own columns), ``n_words``, ``n_hit`` and ``items`` of each document.

    Words are lower-cased runs of ASCII letters, digits and everything beyond ASCII. An item with
    fewer words than a window is one window; one without words (or null) has none, and a null
    document has no words. Items with one id count once, and all items without an id are one item
    without a name: its windows hit, and it is a null in ``items``. Repeated documents are marked alike.
    Words are compared by 64-bit fingerprints, all of a window one by one.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    cuts = materialize(
        items.select(F.col(item_id).cast("string").alias("item"), F.col("text")).mapInArrow(
            _cuts(window), _CUTS
        ),
        "windows",
    )
    total = cuts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    number = F.pmod(F.xxhash64("item", "digest"), F.lit(blocks))
    plain = docs.select(F.col(text).alias("text"))
    # A text travels once, within its row.
    marked = docs.select(
        F.struct("*").alias("row"),
        F.lit(b"").alias("cover"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in marked.schema])
    for i in range(blocks):
        # A block is bounded by block_words: about that many words, and no more by hashing.
        rows = [(r.item, r.digest, r.n) for r in cuts.filter(number == i).toLocalIterator()]
        block = Block(rows, window)
        known = block.vocabulary()
        counts = np.zeros(len(known), np.int64)
        if len(known):
            counted = plain.mapInArrow(_count(context.broadcast(known)), _COUNTS)
            found = counted.groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
            keys = found["shingle"].to_numpy(np.int64).view(np.uint64)
            counts[np.searchsorted(known, keys)] = found["n"].to_numpy()
        block.anchor(known, counts)
        marked = marked.mapInArrow(_mark(share(spark, block), f"row.{text}"), schema)
        if i % _PASSES == _PASSES - 1 and i + 1 < blocks:
            marked = materialize(marked, "marked")
    return marked.select("row", "n_words", "n_hit", "items")


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    The item without an id counts in ``n_items``; the digest is over the named ones.
    """
    found = annotate(docs.select(F.col(id).alias("doc_id"), "text"), items, **options)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item window occurs, with their own columns."""
    return annotate(docs, items, **options).filter("n_hit = 0").select("row.*")

