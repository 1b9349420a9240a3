"""Compression of vectors to codes of parts, with codebooks from member-resident Lloyd rounds.

A vector is cut into equal consecutive parts, and each part position has a codebook of entries.
Training works on parts, which live in a bucketed table: the owner of a bucket holds the members of
some (position, entry, salt). In a round every owner compares its resident members with the last
entries. Those that stay are written where they are, those that change their entry are written
apart and are all that the next shuffle moves; then owners add up what they hold, without an
exchange, since both tables are bucketed alike. Salts cut an entry with many members into owners of
bounded size, and equal parts of one batch travel as one member with a weight. The driver sees the
entries only. Encoding is one pass over whole vectors with the final entries.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.text_arrays import mix
from termloom.session import materialize, scratch_path

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components of more than this size (after scaling) are held at it, so that sums stay exact.
LARGEST = 1 << 24
OWNER_MEMBERS = 200_000
BUCKET_MEMBERS = 4_000_000
_OWNER = ["position", "home", "salt"]
_MEMBERS = "position int, home int, salt int, weight long, part array<int>"
_EXACT = float(1 << 53)
_LONG = 2**63 - 1


@dataclass
class Codebooks:
    """``entries[position][index]`` are the integer components of a part."""

    entries: np.ndarray  # positions × entries × length of a part
    scale: int = SCALE

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """``vec_id, embedding, label`` of the rows whose vector has finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    named = vectors.select(
        F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"),
        (F.col(label) if label else F.lit(None)).alias("label"),
    )
    return named.filter(F.col("embedding").isNotNull() & finite)


def integers(column, width: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(flat * float(scale)), -LARGEST, LARGEST).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and the squared distance, both exact."""
    largest = max((int(np.abs(x).max()) for x in (rows, entries) if x.size), default=0)
    if 4.0 * rows.shape[1] * largest * largest < _EXACT:  # whole numbers of that size are exact as doubles
        wide, own = rows.astype(np.float64), entries.astype(np.float64)
        far = (own * own).sum(axis=1) - 2.0 * (wide @ own.T)
        best = far.argmin(axis=1)
        return best, (far[np.arange(len(rows)), best] + (wide * wide).sum(axis=1)).astype(np.int64)
    best, least = np.zeros(len(rows), np.int64), np.full(len(rows), _LONG)
    for index, entry in enumerate(entries):
        far = ((rows - entry) ** 2).sum(axis=1)
        closer = far < least
        best[closer], least[closer] = index, far[closer]
    return best, least


def _lists(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), pa.int32()))


def _members(position: np.ndarray, home: np.ndarray, salt: np.ndarray, weight: np.ndarray, part: np.ndarray, *more):
    columns = [pa.array(position, pa.int32()), pa.array(home, pa.int32()), pa.array(salt, pa.int32()),
               pa.array(weight, pa.int64()), _lists(part), *[a for _, a in more]]
    return pa.RecordBatch.from_arrays(columns, [*_OWNER, "weight", "part", *[n for n, _ in more]])


def _first_homes(books: Codebooks, salts: int):
    """Whole vectors to members at the first entries."""
    parts, _, size = books.entries.shape

    def run(batches):
        for batch in batches:
            rows = integers(batch.column("embedding"), parts * size, books.scale)
            if not len(rows):
                continue
            mark = np.zeros(len(rows), np.uint64)
            for column in rows.T:
                mark = mix(mark + column.astype(np.uint64))
            for position in range(parts):
                own = np.ascontiguousarray(rows[:, position * size : (position + 1) * size])
                keys = own.view(np.dtype((np.void, own.dtype.itemsize * size))).ravel()
                _, at, count = np.unique(keys, return_index=True, return_counts=True)
                part = own[at]
                home, _ = nearest(part, books.entries[position])
                salt = (mix(mark[at], position) % np.uint64(salts)).astype(np.int64)
                yield _members(np.full(len(at), position), home, salt, count, part)

    return run


def _next_homes(books: Codebooks):
    """Residents with the entry that is nearest now, and whether it is another."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position, home, salt, weight = (batch.column(c).to_numpy() for c in [*_OWNER, "weight"])
            part = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            entry = np.empty(batch.num_rows, np.int64)
            for p in np.unique(position):
                own = position == p
                entry[own], _ = nearest(part[own], books.entries[p])
            yield _members(position, home, salt, weight, part,
                           ("entry", pa.array(entry, pa.int32())), ("moved", pa.array(entry != home)))

    return run


class _Residents:
    """Bucketed tables of members in the shared folder; their names leave the catalog at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, members: DataFrame, by: list[str]) -> DataFrame:
        name = f"residents_{uuid.uuid4().hex}"
        writer = members.write.bucketBy(self.buckets, *_OWNER).option("path", scratch_path(self.spark, "residents"))
        (writer.partitionBy(*by) if by else writer).saveAsTable(name, format="parquet")
        self.names.append(name)
        return self.spark.table(name)

    def settle(self, movers: DataFrame) -> DataFrame:
        """The shuffle: members go to the owners of their entries."""
        return self.write(movers.repartition(self.buckets, *_OWNER), [])

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def sums_of_owners(tables: list[DataFrame], size: int) -> DataFrame:
    """Count and componentwise sums per owner; each table is bucketed by owner, so no member moves."""
    weight = F.col("weight").cast("decimal(38,0)")
    sums = [F.sum(weight).alias("n"), *[F.sum(weight * F.col("part")[i]).alias(f"s{i}") for i in range(size)]]
    return reduce(DataFrame.unionByName, [t.groupBy(*_OWNER).agg(*sums) for t in tables])


def _updated(books: Codebooks, tables: list[DataFrame]) -> Codebooks:
    """Each entry becomes the mean of its members, rounded down; one without members stays."""
    size = books.entries.shape[2]
    totals = sums_of_owners(tables, size).groupBy("position", "home").agg(
        *[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(size)]]]
    )
    entries = books.entries.copy()
    for row in totals.collect():  # as many as there are entries
        entries[row.position, row.home] = [int(row[f"s{i}"]) // int(row.n) for i in range(size)]
    return Codebooks(entries, books.scale)


def fit(
    kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    owner_members: int = OWNER_MEMBERS,
) -> Codebooks | None:
    """Codebooks of the rows of ``usable``; None without any row.

    A codebook starts with the parts of the first ``entries`` vectors by id (a null id comes last,
    equal ids by their vectors), fewer if there are fewer. Vectors are filled up with zeros to the
    longest one and to a multiple of ``parts``. Read ``kept`` from files: rows that change between
    two reads would change their owners.
    """
    spark = kept.sparkSession
    seen = kept.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not seen.n:
        return None
    size = max(1, -(-seen.width // parts))
    first = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    seeds = pa.array([r.embedding for r in first.collect()], pa.list_(pa.float64()))
    start = integers(seeds, parts * size, scale).reshape(len(seeds), parts, size).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), scale)
    salts = -(-seen.n // owner_members)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.n * parts // BUCKET_MEMBERS))
    residents = _Residents(spark, buckets)
    try:
        members = None
        for _ in range(rounds):
            if members is None:
                members = [residents.settle(kept.select("embedding").mapInArrow(_first_homes(books, salts), _MEMBERS))]
            else:
                held = reduce(DataFrame.unionByName, members)
                compared = held.mapInArrow(_next_homes(books), f"{_MEMBERS}, entry int, moved boolean")
                table = residents.write(compared, ["moved"])
                stay = table.filter(~F.col("moved")).select(*_OWNER, "weight", "part")
                movers = table.filter("moved").select("position", F.col("entry").alias("home"), "salt", "weight", "part")
                members = [stay, residents.settle(movers)]
            books = _updated(books, members)
    finally:
        residents.drop()
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of the rows of ``usable``: one pass, no shuffle.

    ``code`` has two hex digits for each part (more if a codebook has over 256 entries), ``error``
    is the sum of the squared distances.
    """
    parts, count, size = books.entries.shape
    digits = max(2, len(f"{count - 1:x}"))
    hexes = np.array([f"{i:0{digits}x}" for i in range(count)])

    def run(batches):
        for batch in batches:
            rows = integers(batch.column("embedding"), parts * size, books.scale)
            code, error = np.empty((len(rows), parts), hexes.dtype), np.zeros(len(rows), np.int64)
            for position in range(parts):
                best, far = nearest(rows[:, position * size : (position + 1) * size], books.entries[position])
                code[:, position] = hexes[best]
                error += far
            text = np.ascontiguousarray(code).view(f"U{digits * parts}").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text.tolist(), pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row with a usable vector.

    Rows whose vector is null, or holds a null or non-finite component, have no row; others are
    all kept, repeated rows and null ids too. Components beyond ``LARGEST`` are held at it.
    Vectors of other lengths than the longest count as filled up with zeros, the empty one too.
    ``label_error`` is the sum of ``error`` over equal labels, nulls together. No rows give no rows.
    """
    kept = usable(vectors, id, vector, label)
    books = fit(kept, **options)
    if books is None:
        books = Codebooks(np.zeros((options.get("parts", PARTS), 1, 1), np.int64))
    coded = materialize(encode(kept, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
