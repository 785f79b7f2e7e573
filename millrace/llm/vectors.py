"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> str:
    """SQL: the vector isn't null or zero and has neither null nor non-finite components."""
    return (
        f"coalesce({column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        f"and exists({column}, x -> x <> 0), false)"
    )


def lengths(df: DataFrame, column: str = "embedding") -> list[int]:
    """The different lengths of usable vectors. Only vectors of one length can be compared; each length is a search of its own."""
    return sorted(r["d"] for r in df.filter(usable(column)).select(F.size(column).alias("d")).distinct().collect())


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, one component after another: the same for a pair in whatever block and order it comes."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total
