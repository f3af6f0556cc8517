"""Helpers for embedding tables: which vectors take part, and cosines in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(embedding: Column | str = "embedding") -> Column:
    """False for vectors that are null, empty, zero, or hold a null or a component that is not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce(~F.exists(e, bad) & F.exists(e, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, as doubles."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, scaled so that no square overflows or vanishes."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1.0
    return np.sqrt(np.einsum("ij,ij->i", x / top[:, None], x / top[:, None])) * top


def unit(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, from unit vectors, summed in one fixed order."""
    return np.einsum("ij,ij->i", x, y)
