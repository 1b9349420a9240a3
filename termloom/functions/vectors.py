"""Vector expressions and the float32 blob format."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a vector without direction.

    For single pairs. All-pairs work belongs to ``operators.similarity``.
    """
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((norms > 0) & ~F.isnan(norms), _dot(x, y) / norms)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _floats(blobs: pa.Array) -> pa.Array:
    """All blobs lie in one buffer, which is read as numbers without a loop."""
    blobs = pa.concat_arrays([blobs.cast(pa.large_binary())]) if blobs.offset else blobs.cast(pa.large_binary())
    blank = np.array(blobs.is_null())
    bounds = np.frombuffer(blobs.buffers()[1], np.int64, len(blobs) + 1, blobs.offset * 8)
    sizes = np.where(blank, 0, np.diff(bounds))
    if (sizes % 4).any():
        raise ValueError("an embedding is no sequence of float32 values")
    data = blobs.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    if (np.diff(bounds)[blank] > 0).any():  # bytes behind a null count for nothing
        raw = raw[np.repeat(~blank, np.diff(bounds))]
    edges = np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32)
    values = pa.array(np.ascontiguousarray(raw).view("<f4"))
    return pa.ListArray.from_arrays(pa.array(edges), values, mask=pa.array(blank))


@F.pandas_udf(T.BinaryType())
def _blobs(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def decode_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Little-endian float32 blobs to ``array<float>``."""
    return df.withColumn(column, _floats(column))


def encode_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``array<float>`` to little-endian float32 blobs, for exchange files."""
    return df.withColumn(column, _blobs(column))
