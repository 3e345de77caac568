"""Integer vectors from columns of floating-point arrays, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: whole components are held to this range, so that sums of their products stay exact
LARGEST = 1 << 20


def usable(vector: str) -> Column:
    """True for arrays that are not null and whose components are all known and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double, held to +-``LARGEST``."""
    most = float(LARGEST)
    return F.transform(
        vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-most)), F.lit(most)).cast("int")
    )


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column that all have one length, as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of whole components, exact: in floating point where every sum stays below 2**53, else in 64 bits."""
    if LARGEST * LARGEST * a.shape[-1] < 1 << 53:
        return (a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)
