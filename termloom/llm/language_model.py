"""N-gram language model in sharded Elias-Fano tries, learned from and asked by the whole corpus.

First documents are put into blocks of a few megabytes. A block sends each shard the sorted distinct
n-grams of its training documents with their counts; the shard adds the counts of all blocks up and
writes one trie level per order, as a file of the shared folder. Then every block asks the shards for
its n-grams, and each shard answers from its mapped levels alone. A frequent n-gram is one entry per
block in both rounds, and no task ever sees a whole model.

A shard is chosen by bits of the context, so the n-grams of one context lie together and its total is
known where they are. What blocks hold for each shard is counted first, and one with more than twice
its due is cut further by the words; its parts are sent the totals of its contexts.

Inside a shard a key has 32 bits of the context and 32 bits of the word relative to it, so with 1.2
million entries a context is taken for another one with a probability below 3e-4, and an unseen word
for a seen one with followers * 2^-32. The probability of a word interpolates the orders. A level holds
for each n-gram its relative frequency, as a logarithm in steps of 1/64 bit, and for each context the
number of its codebook entry: contexts of one size in powers of two share their weight of the shorter
context, which is the share of training words whose n-gram occurs only once. The entry turns
the frequency into the smoothed probability.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.elias_fano import Level
from termloom.llm.text_arrays import PLAIN, mix, pieces, text_buffer, words
from termloom.session import materialize, scratch_path

ORDER = 2
BLOCK_BYTES = 6 << 20
SHARD_ENTRIES = 1_200_000
STEP = 64  # codes per halving of a frequency
_LOW = np.uint64((1 << 32) - 1)
_HALF = np.uint64(32)
_END = 0xE4D0F7E475E4D0F7
_BLOCKS = "block long, ids binary, held binary, sizes binary, texts binary, loads binary"
_SENT = "shard long, block long, payload binary"
_LEVELS = "shard long, path string, data binary, types long, tokens long, usage array<struct<k: long, size: long, n: long, single: long>>"
_ANSWERS = "block long, shard long, payload binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _frame(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _parts(data: bytes, count: int) -> list[bytes]:
    sizes = np.frombuffer(data[: 8 * count], np.int64)
    edges = 8 * count + np.concatenate([[0], np.cumsum(sizes)])
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def codes_of(shares: np.ndarray) -> np.ndarray:
    """0 for a share of 0, else one more than the rounded logarithm of its inverse."""
    logs = -np.log2(np.where(shares > 0, shares, 1.0)) * STEP
    return np.where(shares > 0, 1 + np.minimum(np.rint(logs), 65_000), 0).astype(np.uint16)


def share_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2(-(codes.astype(np.float64) - 1) / STEP), 0.0)


def size_of(counts: np.ndarray) -> np.ndarray:
    """Powers of two in a count, from 1."""
    return np.frexp(np.asarray(counts, np.float64))[1] - 1


def _blocks(order: int, bits: int):
    """Whole documents side by side, compressed, and how many n-grams each shard gets of them."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, BLOCK_BYTES):
                data, offsets = text_buffer(part.column("text"))
                ids = part.column("doc_id")
                known = np.array(ids.is_valid())
                number = ids.fill_null(0).to_numpy().astype(np.int64)
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
                body = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
                # The table of blocks is written once, so a name only has to be its own.
                name = int.from_bytes(os.urandom(8), "little") >> 1
                row = (number.tobytes() + known.tobytes(), held.tobytes(), np.diff(offsets).tobytes(), body)
                loads = Block(*row).loads(order, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (*row, loads))],
                    ["block", "ids", "held", "sizes", "texts", "loads"],
                )

    return run


class Block:
    """Documents of one block as word numbers, each ended by the end token."""

    def __init__(self, ids: bytes, held: bytes, sizes: bytes, texts: bytes):
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        n = len(self.held)
        self.ids = np.frombuffer(ids[: 8 * n], np.int64)
        self.known = np.frombuffer(ids[8 * n :], bool)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        found = words(data, offsets, PLAIN, lower=True)
        digest, first = found.hashes(), found.first
        self.first = first + np.arange(n + 1)
        self.tokens = np.full(len(digest) + n, _END, np.uint64)
        self.tokens[np.arange(len(digest)) + np.repeat(np.arange(n), np.diff(first))] = digest
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.place = np.arange(len(self.tokens)) - self.first[self.doc]

    def keys(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that end an n-gram of this order, its shard and its key."""
        if order == 1:
            at, context, key = np.arange(len(self.tokens)), self.tokens, mix(self.tokens)
        else:
            at = np.flatnonzero(self.place >= order - 1)
            context = np.zeros(len(at), np.uint64)
            for j in range(order - 1, 0, -1):
                context = mix(context + self.tokens[at - j], j)
            child = mix(context + self.tokens[at], order + 100)
            key = (((context << np.uint64(bits)) >> _HALF) << _HALF) | (child >> _HALF)
        shard = (context >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
        return at, shard, key

    def loads(self, order: int, bits: int) -> bytes:
        """Numbers of shards, and how many distinct n-grams of this block they get."""
        total = np.zeros(0, np.int64)
        for k in range(1, order + 1):
            _, shard, key = self.keys(k, bits)
            mark = mix(key) >> np.uint64(bits)
            both = np.sort((shard.astype(np.uint64) << np.uint64(64 - bits)) | mark) if bits else np.sort(mark)
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            total = np.append(total, (both >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(both), np.int64))
        shards, counts = np.unique(total, return_counts=True)
        return np.stack([shards, counts]).astype(np.int64).tobytes()


def _loads(batches):
    """Entries of each shard, added up in a task."""
    total: dict[int, int] = {}
    for batch in batches:
        for row in batch.column("loads"):
            shards, counts = np.frombuffer(row.as_py(), np.int64).reshape(2, -1)
            for s, n in zip(shards.tolist(), counts.tolist(), strict=True):
                total[s] = total.get(s, 0) + n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["shard", "n"]
    )


class Spread:
    """Where n-grams go: to their shard, or to one of the parts of a shard that has too many."""

    def __init__(self, bits: int, loads: dict[int, int], most: int):
        self.bits = bits
        self.hot = np.array(sorted(loads), np.int64)
        self.cuts = np.array([-(-loads[s] // most) for s in self.hot.tolist()], np.int64)
        self.base = (1 << bits) + np.cumsum(self.cuts) - self.cuts

    def targets(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return shard
        at = np.minimum(np.searchsorted(self.hot, shard), len(self.hot) - 1)
        part = (key & _LOW).astype(np.int64) % self.cuts[at]
        return np.where(self.hot[at] == shard, self.base[at] + part, shard)

    def parts(self):
        return zip(self.hot.tolist(), self.base.tolist(), self.cuts.tolist(), strict=True)


def _distinct(target: np.ndarray, key: np.ndarray):
    """Distinct n-grams by target and key: target, key, how often, and the number of each given one."""
    turn = np.argsort(key)
    small = target[turn].astype(np.uint16) if len(target) and target.max() < 1 << 16 else target[turn]
    turn = turn[np.argsort(small, kind="stable")]
    target, key = target[turn], key[turn]
    heads = np.ones(len(key), bool)
    heads[1:] = (key[1:] != key[:-1]) | (target[1:] != target[:-1])
    number = np.empty(len(key), np.int64)
    number[turn] = np.cumsum(heads) - 1
    first = np.flatnonzero(heads)
    return target[first], key[first], np.diff(np.append(first, len(key))), number


def _runs(target: np.ndarray):
    """Each target with the range of its entries."""
    if not len(target):
        return ()
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    return zip(target[first].tolist(), first.tolist(), np.append(first[1:], len(target)).tolist(), strict=True)


def _rising(values: np.ndarray) -> bytes:
    return _squeeze(np.diff(values, prepend=np.uint64(0)))


def _read_blocks(batch, *more):
    for row in zip(*(batch.column(c) for c in ("block", "ids", "held", "sizes", "texts", *more)), strict=True):
        name, *parts = (x.as_py() for x in row)
        yield name, Block(*parts[:4]), *parts[4:]


def _send(own: dict[int, list[bytes]], name: int):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(own), pa.int64()), pa.array([name] * len(own), pa.int64()),
            pa.array([_frame(p) for p in own.values()], pa.binary()),
        ],
        ["shard", "block", "payload"],
    )


def _count(order: int, spread: Spread):
    """n-grams of training documents with their counts; parts of a shard also get totals of contexts."""

    def run(batches):
        for batch in batches:
            for name, block in _read_blocks(batch):
                train = ~block.held[block.doc]
                own: dict[int, list[bytes]] = {}
                for k in range(order):
                    at, shard, key = block.keys(k + 1, spread.bits)
                    shard, key = shard[train[at]], key[train[at]]
                    target, keys, counts, _ = _distinct(spread.targets(shard, key), key)
                    for s, low, high in _runs(target):
                        parts = own.setdefault(s, [b""] * (4 * order))
                        parts[4 * k] = _rising(keys[low:high])
                        parts[4 * k + 1] = _squeeze(counts[low:high].astype(np.uint32))
                    for s, base, cuts in spread.parts() if k else ():
                        contexts, totals = np.unique(key[shard == s] >> _HALF, return_counts=True)
                        if len(contexts):
                            sent = _rising(contexts), _squeeze(totals.astype(np.uint32))
                            for target in range(base, base + cuts):
                                own.setdefault(target, [b""] * (4 * order))[4 * k + 2 : 4 * k + 4] = sent
                yield _send(own, name)

    return run


def _ask(order: int, spread: Spread):
    """Distinct n-grams of all documents."""

    def run(batches):
        for batch in batches:
            for name, block in _read_blocks(batch):
                own: dict[int, list[bytes]] = {}
                for k in range(order):
                    _, shard, key = block.keys(k + 1, spread.bits)
                    target, keys, _, _ = _distinct(spread.targets(shard, key), key)
                    for s, low, high in _runs(target):
                        own.setdefault(s, [b""] * order)[k] = _rising(keys[low:high])
                yield _send(own, name)

    return run


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, np.uint64), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def _added(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.concatenate([_keys(x) for x in keys])
    weights = np.concatenate([_expand(x, np.uint32) if x else np.zeros(0, np.uint32) for x in counts])
    union, back = np.unique(joined, return_inverse=True)
    return union, np.bincount(back, weights, len(union)).astype(np.int64)


def _build(order: int, folder: str | None):
    """Levels of a shard from the counts of all blocks; a file, or bytes where tasks cannot map files."""

    def run(table: pa.Table) -> pa.Table:
        sent = [_parts(x.as_py(), 4 * order) for x in table.column("payload")]
        levels, usage = [], []
        types = tokens = 0
        for k in range(order):
            keys, counts = _added([p[4 * k] for p in sent], [p[4 * k + 1] for p in sent])
            contexts = keys >> _HALF
            every, back = np.unique(contexts, return_inverse=True)
            if k == 0:
                types, tokens = len(keys), int(counts.sum())
                levels.append(Level(contexts, keys & _LOW, counts.astype(np.uint64), every, np.zeros(len(every))))
                continue
            totals = np.bincount(back, counts, len(every))
            if any(p[4 * k + 2] for p in sent):  # a part of a shard
                every, totals = _added([p[4 * k + 2] for p in sent], [p[4 * k + 3] for p in sent])
                back = np.searchsorted(every, contexts)
            sizes = size_of(totals)
            levels.append(Level(contexts, keys & _LOW, codes_of(counts / totals[back]), every, sizes + 1))
            seen = np.bincount(sizes[back], counts, 64).astype(int)
            single = np.bincount(sizes[back], counts == 1, 64).astype(int)
            usage += [{"k": k + 1, "size": i, "n": seen[i], "single": single[i]} for i in np.flatnonzero(seen).tolist()]
        data, path = _frame([x.dump() for x in levels]), None
        if folder:
            # Each attempt writes its own file; only the one in the table is read.
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"{uuid.uuid4().hex}.levels")
            with open(path, "wb") as out:
                out.write(data)
            data = None
        row = {
            "shard": table.column("shard")[0].as_py(), "path": path, "data": data, "types": types, "tokens": tokens, "usage": usage,
        }
        kind = pa.struct([(n, pa.int64()) for n in ("k", "size", "n", "single")])
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(kind)]
        return pa.table({c: pa.array([v], t) for (c, v), t in zip(row.items(), kinds, strict=True)})

    return run


def _opened(row: dict, order: int) -> list[Level]:
    data = np.asarray(np.memmap(row["path"], np.uint8, "r")) if row["path"] else np.frombuffer(row["data"], np.uint8)
    edges = 8 * order + np.concatenate([[0], np.cumsum(data[: 8 * order].view(np.int64))])
    return [Level.load(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _answer(order: int):
    """For each block's n-grams the count of words, and codes of longer ones and of their contexts."""

    def run(asked: pa.Table, levels: pa.Table) -> pa.Table:
        sent = [_parts(x.as_py(), order) for x in asked.column("payload")]
        stored = [_opened(row, order) for row in levels.select(["path", "data"]).to_pylist()]
        out = [[] for _ in sent]
        for k in range(order) if sent else ():
            keys = [_keys(p[k]) for p in sent]
            union, back = np.unique(np.concatenate(keys), return_inverse=True)
            value, mark = np.zeros(len(union), np.uint16 if k else np.uint64), np.zeros(len(union), np.uint8)
            for level in stored:  # one, or none for a shard without training words
                value, mark = level[k].find(union >> _HALF, union & _LOW)
            low = 0
            for i, own in enumerate(keys):
                at = back[low : low + len(own)]
                out[i] += [_squeeze(value[at]), _squeeze(mark[at])] if len(own) else [b"", b""]
                low += len(own)
        return pa.table(
            {
                "block": asked.column("block").cast(pa.int64()), "shard": asked.column("shard").cast(pa.int64()),
                "payload": pa.array([_frame(p) for p in out], pa.binary()),
            }
        )

    return run


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_expand(x, kind) for x in parts if x)])


def _score(order: int, spread: Spread, tokens: int, types: int, weights: np.ndarray):
    """Scores of documents from the answers; ``weights[k, size]`` is that of the shorter context."""

    def run(batches):
        for batch in batches:
            for _, block, answers in _read_blocks(batch, "answers"):
                replies = [_parts(a["payload"], 2 * order) for a in sorted(answers, key=lambda a: a["shard"])]
                for k in range(order):
                    at, shard, key = block.keys(k + 1, spread.bits)
                    target, _, _, number = _distinct(spread.targets(shard, key), key)
                    value = _joined([r[2 * k] for r in replies], np.uint16 if k else np.uint64)
                    mark = _joined([r[2 * k + 1] for r in replies], np.uint8).astype(np.int64)
                    if len(value) != len(target):
                        raise ValueError("a block's answers do not fit its n-grams")
                    if k == 0:
                        counts = value[number]
                        p = base = (counts + 1.0) / (tokens + types + 1.0)
                        continue
                    share = np.where(mark > 0, weights[k + 1, np.maximum(mark - 1, 0)], 1.0)
                    p = p.copy()
                    p[at] = ((1 - share) * share_of(value))[number] + share[number] * p[at]
                first = block.first
                columns = [
                    pa.array(block.ids, mask=~block.known), pa.array(block.held), pa.array(np.diff(first)),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), first[:-1])),
                    pa.array(np.add.reduceat(np.log10(base), first[:-1])), pa.array(np.add.reduceat(np.log10(p), first[:-1])),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                )

    return run


def _folder(spark) -> str | None:
    """A folder for levels that tasks can map, or None where the shared one is no file system of theirs."""
    path = scratch_path(spark, "levels")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hadoop.toUri().getPath() if system.getUri().getScheme() == "file" else None


def score_documents(
    docs: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES, map_files: bool = True
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document.

    ``docs`` has ``doc_id``, ``text`` and ``held_out``; the model learns from the rows that are not
    held out. Tokens are words at ASCII white space, A-Z lower-cased, and one end per document, so
    a null or empty text is the end alone. Repeated rows count each time and score alike. Without
    any training row every token is unknown. Levels are mapped files of the shared folder; where it
    is no file system of the tasks, or without ``map_files``, they are bytes of a written table.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes are one token, and a token is one n-gram of each order.
    bits = max(0, -(-size * order // (6 * shard_entries)) - 1).bit_length()
    blocks = materialize(rows.mapInArrow(_blocks(order, bits), _BLOCKS), "blocks")
    loads = blocks.select("loads").mapInArrow(_loads, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    hot = {r.shard: r.n for r in loads.filter(F.col("n") > 2 * shard_entries).collect()}
    spread = Spread(bits, hot, shard_entries)
    counted = blocks.drop("loads").mapInArrow(_count(order, spread), _SENT).groupBy("shard")
    levels = materialize(counted.applyInArrow(_build(order, _folder(spark) if map_files else None), _LEVELS), "levels")
    total = levels.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = total[0] or 0, total[1] or 0
    weights = np.ones((order + 1, 64))
    usage = levels.select(F.inline("usage")).groupBy("k", "size").agg(F.sum("n").alias("n"), F.sum("single").alias("single"))
    for row in usage.collect():
        weights[row.k, row["size"]] = (row.single + 1) / (row.n + 2)
    asked = blocks.drop("loads").mapInArrow(_ask(order, spread), _SENT).groupBy("shard")
    answers = asked.cogroup(levels.select("shard", "path", "data").groupBy("shard")).applyInArrow(_answer(order), _ANSWERS)
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"))
    scored = blocks.drop("loads").join(gathered, "block").mapInArrow(_score(order, spread, tokens, types, weights), _SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
