"""Vectors in Arrow batches as matrices, and exact arithmetic on what they round to.

Integers stay in int64 as long as every distance fits; larger ones become Python's own, which have
no bound. Sums travel in limbs of LIMB bits, so that no count of rows can overflow them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.runtime import quoted

LIMB = 48
LONG_MOST = (1 << 63) - 1


def plain_vectors(df: DataFrame, vector: str) -> Column:
    """The vector column as array<float> or array<double>."""
    kind = df.schema[vector].dataType
    col = F.col(quoted(vector))
    is_float = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)
    return col if is_float else col.cast("array<double>")


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has dims components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and these rows as float64."""
    length = np.asarray(column.value_lengths().fill_null(-1))
    right = length == dims
    values = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    right[right] = finite
    return right, values[finite]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; as Python integers where int64 is too small."""
    if not x.size or np.abs(x).max() < (1 << 61) / scale:
        return np.floor(x * scale).astype(np.int64)
    one = lambda v: int(np.floor(v * scale)) if abs(v) < 1 << 50 else int(v) * scale
    return np.array([[one(v) for v in row] for row in x.tolist()], dtype=object)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def alike(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in int64 if squared distances between them fit, else both as Python integers."""
    if x.dtype != object and c.dtype != object and (largest(x) + largest(c)) ** 2 * max(1, x.shape[-1]) <= LONG_MOST:
        return x, c
    return x.astype(object), c.astype(object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of x and of c."""
    x, c = alike(x, c)
    d = x - c
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, dtype=np.int64)


def limbs(value: int) -> list[int]:
    """value = sum(limb[i] << LIMB * i); every limb fits a long."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def as_longs(values: np.ndarray) -> pa.Array:
    """Longs; null where a value is larger than a long."""
    return pa.array([int(v) if v <= LONG_MOST else None for v in values.tolist()], pa.int64())
