"""Vectors in Arrow batches, and sums of arrays over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_batches

# Partial results meet in so many tasks, each of which adds them up one by one.
FAN_IN = 8
# At most so many components of vectors are worked on at a time, or one vector.
AT_ONCE = 1 << 21


def finite(vector: Column) -> Column:
    """The vector is there and all of its components are finite numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int:
    """The number of components that most vectors have (of the like the largest), 0 without any."""
    sizes = vectors.groupBy(F.size(column).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.where("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    return row["size"] if row else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of `dim` numbers a row, without nulls, as rows of doubles."""
    return np.asarray(pc.list_flatten(column).cast(pa.float64()), dtype=np.float64).reshape(-1, dim)


def parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to AT_ONCE components."""
    rows = max(1, AT_ONCE // max(1, dim))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def total(
    rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], zero: np.ndarray, dim: int, column: str = "x"
) -> np.ndarray:
    """The sum over all rows of `of(batch)`, an array like `zero` (integers or doubles).

    A task sends one array however many rows it has; FAN_IN tasks add those up, and the
    driver adds up what is left.
    """
    schema, kind, shape = StructType([StructField("sum", BinaryType())]), zero.dtype.str, zero.shape

    def one(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([found.astype(kind).tobytes()], pa.binary())], names=["sum"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = zero.copy()
        for batch in parts(batches, dim):
            if batch.num_rows:
                found += of(batch)
        yield one(found)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = zero.copy()
        for batch in batches:
            for x in batch.column("sum"):
                found += np.frombuffer(x.as_buffer(), dtype=kind).reshape(shape)
        yield one(found)

    left = map_batches(rows.select(column), first, schema)
    left = map_batches(left.repartition(FAN_IN), again, schema)
    found = zero.copy()
    for row in left.toLocalIterator():
        found += np.frombuffer(bytes(row["sum"]), dtype=kind).reshape(shape)
    return found
