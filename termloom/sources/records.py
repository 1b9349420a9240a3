"""Records of delimited text that may hold line breaks inside quotes, read in parallel.

Spark splits a file into byte ranges and its lines into those; whether a line begins a record
depends on the quotes before it. So one scan counts the quotes of each range, and their parities,
added up along a file, tell which ranges begin inside a quoted value. The second scan then finds
the records of each range on its own. Only the pieces of records that cross a border of ranges are
brought together. Quotes inside values have to be doubled, as the format wants it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _END, _MIDDLE, _BEGIN = 0, 1, 2, 3
_PIECES = "file string, range long, kind int, header boolean, record string"
_RANGE = ["file", "range"]


def read_records(spark: SparkSession, path) -> DataFrame:
    """``record``: every record of the files but the first of each, without its line end.

    Line ends are ``\\n`` or ``\\r\\n``; those inside quotes are kept as they are. Blank records are
    left out. A file that ends inside quotes gives what is there as its last record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy(*_RANGE).agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = odd.select(*_RANGE, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # One short row per range of many megabytes, and lines stay in their order beside a broadcast.
    known = lines.join(F.broadcast(inside), _RANGE)
    pieces = known.mapInArrow(_split, _PIECES)
    order = Window.partitionBy("file").orderBy("range", "kind")
    number = F.sum(F.when(F.col("kind") == _BEGIN, 1).otherwise(0)).over(order)
    parts = F.sort_array(F.collect_list(F.struct("range", "kind", "record")))
    crossing = pieces.filter(F.col("kind") != _WHOLE).withColumn("number", number).groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.max("header").alias("header"),
    )
    every = pieces.filter(F.col("kind") == _WHOLE).select("record", "header").unionByName(crossing.select("record", "header"))
    record = F.regexp_replace("record", "\r$", "")
    return every.filter(~F.col("header")).select(record.alias("record")).filter("record <> ''")


def _split(batches):
    """Records of each range, and the pieces at its ends; lines of a range come in order."""
    here, held, kind, header, state = None, [], _END, False, False

    def piece(at, kind, header, texts):
        columns = [pa.array([at[0]]), pa.array([at[1]]), pa.array([kind], pa.int32()), pa.array([header]),
                   pa.array(["\n".join(texts)])]
        return pa.RecordBatch.from_arrays(columns, ["file", "range", "kind", "header", "record"])

    for batch in batches:
        files, ranges = batch.column("file"), batch.column("range").to_numpy()
        codes = pc.dictionary_encode(files).indices.to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            at = (files[low].as_py(), int(ranges[low]))
            if at != here:
                if held:  # what the range before ends with
                    yield piece(here, _MIDDLE if kind == _END else _BEGIN, header, held)
                here, held, state = at, [], batch.column("inside")[low].as_py()
                kind, header = _END if state else _BEGIN, at[1] == 0
            values = batch.column("value").slice(low, high - low)
            count = pc.count_substring(values, '"').to_numpy()
            after = (np.cumsum(count) + state) % 2 == 1
            begins = np.concatenate([[not state], ~after[:-1]])
            single = begins & ~after
            if header and (first := np.flatnonzero(single)).size and not held and first[0] == 0 and kind == _BEGIN:
                yield piece(at, _WHOLE, True, [values[0].as_py()])
                single[0], begins[0], header = False, False, False
                start = 1
            else:
                start = 0
            for i in np.flatnonzero(~single[start:]) + start:  # lines of records with line breaks
                held.append(values[int(i)].as_py())
                if not after[i]:
                    yield piece(at, _WHOLE if kind == _BEGIN else _END, header, held)
                    held, kind, header = [], _BEGIN, False
            state = bool(after[-1])
            whole = values.filter(pa.array(single))
            if len(whole):
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * n), pa.array(np.full(n, at[1])), pa.array(np.zeros(n, np.int32)),
                     pa.array(np.zeros(n, bool)), whole], ["file", "range", "kind", "header", "record"],
                )
    if held:
        yield piece(here, _MIDDLE if kind == _END else _BEGIN, header, held)
