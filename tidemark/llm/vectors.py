"""What the operators on vectors share: which rows take part, exact integers, exact long values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 1 << 63


def finite(df: DataFrame, column: str = "embedding") -> Column:
    """Whether the vector is there and holds neither null nor a value that is not finite."""
    sound = F.forall(F.col(column).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & sound, F.lit(False))


def stored(df: DataFrame, column: str = "embedding") -> Column:
    """The vector in the narrowest type that keeps it: as it is if of floats, else of doubles."""
    return F.col(column).cast("array<float>" if df.schema[column].dataType.simpleString() == "array<float>" else "array<double>")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles. No nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("the vectors differ in length")
    return flat.reshape(len(lengths), int(lengths[0]) if len(lengths) else 0)


def scaled(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) for a power of two: 64-bit integers, or Python's where one does not fit half of them."""
    with np.errstate(over="ignore"):
        out = np.floor(x * factor)  # a power of two rounds nothing
    if not out.size or np.abs(out).max() < 1 << 62:
        return out.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else int(u) * factor for v, u in zip(a, b, strict=True)] for a, b in zip(out.tolist(), x.tolist(), strict=True)], object)


def as_float(values: np.ndarray) -> np.ndarray:
    """Nearest doubles of integers; infinite beyond."""
    if values.dtype != object:
        return values.astype(np.float64)

    def one(v: int) -> float:
        try:
            return float(v)
        except OverflowError:
            return float("inf") if v > 0 else float("-inf")

    return np.array([one(v) for v in values.ravel().tolist()], np.float64).reshape(values.shape)


def lengths(q: np.ndarray) -> np.ndarray:
    """Norms of rows of integers, but for rounding; infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return np.sqrt((as_float(q) ** 2).sum(axis=1))


def longs(values) -> pa.Array:
    """64-bit integers; null where one does not fit."""
    return pa.array([int(v) if -LONG <= v < LONG else None for v in values], pa.int64())
