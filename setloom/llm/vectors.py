"""Vectors of a table as arrays of whole numbers, exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this, 64-bit floats hold every whole number.
EXACT = 1 << 53


def kept_vectors(table: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``embedding`` of the rows whose vector has entries, none of them null or not finite."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return table.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select(*columns, "embedding")


def entries(vectors: pa.Array, size: int) -> np.ndarray:
    """A column of vectors as 64-bit floats, a row a vector; an error if one has not ``size`` entries."""
    lengths = set(pc.unique(pc.list_value_length(vectors)).to_pylist())
    if lengths - {size}:
        raise ValueError(f"vectors have {size} entries and {sorted(lengths - {size})[0]}; they must have as many each")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two: 64-bit integers, or Python's where a value is too large for floats to be exact."""
    if np.abs(values).max(initial=0.0) < EXACT / scale:
        return np.floor(values * scale).astype(np.int64)
    # a float from 2^53 on is whole; a smaller one can be scaled without rounding
    exact = [int(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in values.ravel().tolist()]
    out = np.empty(values.size, object)
    out[:] = exact
    return out.reshape(values.shape)


def magnitude(values: np.ndarray) -> int:
    return max((abs(int(x)) for x in (values.min(), values.max())), default=0) if values.size else 0
