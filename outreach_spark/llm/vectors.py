"""Helpers of the vector searches: scaled rows as a table, array columns as matrices, best entries."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are held to this size, so that inner products of up to 8,192 of them are exact in doubles.
HOLD = 1 << 20


def finite(vec: Column) -> Column:
    """Non-null, with no null, infinite or NaN component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vec: Column, scale: float) -> Column:
    """Components as integers: ``floor(scale * x)`` with x as double, held to ``HOLD``."""
    return F.transform(vec, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-HOLD)), F.lit(HOLD)).cast("int"))


def padded(rows: DataFrame, dims: int, col: str = "v", fill: int | float = 0) -> DataFrame:
    """Shorter vectors get zeros at the end (``fill``: a zero of their type)."""
    missing = F.lit(dims) - F.size(col)
    return rows.withColumn(col, F.when(missing > 0, F.concat(F.col(col), F.array_repeat(F.lit(fill), missing))).otherwise(F.col(col)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries of every row; of equal ones the earlier columns."""
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, tie = scores > kth, scores == kth
        tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)
        keep = (above | tie) & (scores > -np.inf)
    else:
        keep = scores > -np.inf
    return np.nonzero(keep)


def kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest entry of every row, -inf where there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as got:
        return {name: got[name] for name in got.files}
