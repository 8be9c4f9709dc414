"""What the vector operators share: usable vectors, and their exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has dims finite components, one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimensions(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the larger of two as common); 0 without any."""
    first = vectors.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of dims numbers as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither vanish nor overflow."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
