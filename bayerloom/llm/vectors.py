"""What the operators on integer vectors share: usable rows, and blocks of them as matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor what isn't finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def finite_rows(vectors: DataFrame, *columns: Column, vector_column: str = "embedding") -> DataFrame:
    """The given columns, and the vector as v, of the rows whose vectors are finite."""
    return vectors.where(is_finite(F.col(vector_column))).select(*columns, F.col(vector_column).alias("v"))


def largest_component(dimensions: int) -> int:
    """Integers up to this have inner products that 63 bits hold."""
    return math.isqrt(((1 << 63) - 1) // max(dimensions, 1))


def floored(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of doubles as integers, held to -most..most."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], scale: int, size: int, limit) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """(dimensions, rows without v, their integer vectors) of blocks of at most `size` components, each of vectors of one length.

    limit: the largest integer for a number of dimensions.
    """
    held: dict[int, list] = {}
    waiting = 0

    def given(d: int) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
        parts = held.pop(d)
        rows = pa.Table.from_batches([p[0] for p in parts]).combine_chunks()
        values = np.concatenate([p[1] for p in parts])
        most = max(1, size // max(d, 1))
        for at in range(0, len(values), most):
            yield d, rows.slice(at, most), values[at : at + most]

    for batch in batches:
        lengths = pc.list_value_length(batch.column("v")).to_numpy()
        for d in np.unique(lengths).tolist():
            part = batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))
            values = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
            held.setdefault(d, []).append((part.drop_columns(["v"]), floored(values, scale, limit(d))))
            waiting += values.size + len(values)
            if sum(len(p[1]) for p in held[d]) * max(d, 1) >= size:
                waiting -= sum(p[1].size + len(p[1]) for p in held[d])
                yield from given(d)
        if waiting >= 4 * size:  # many lengths, each of few rows
            for d in list(held):
                yield from given(d)
            waiting = 0
    for d in list(held):
        yield from given(d)
