"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, scale: int, column: str, limit: int, dims: int | None = None) -> DataFrame:
    """df with `column` as array<int> of floor(scale * x), x as double. Rows whose vector is null, has null or non-finite
    components, or hasn't `dims` components where that is given, go. A component of `limit` or more in size is an error,
    as an overflow is in Spark's ANSI mode: squared distances couldn't be held in a long.
    """
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    fits = finite if dims is None else (F.size(column) == dims) & finite
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    size = F.transform(column, lambda x: F.abs(x.cast("double") * scale))
    checked = F.when(F.forall(size, lambda x: x < limit), scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {limit} or more")).cast("array<int>"))
    return df.filter(F.col(column).isNotNull() & fits).withColumn(column, checked)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of `dims` whole numbers a row as a matrix of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)
