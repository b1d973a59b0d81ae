"""What the operators share: tables, written intermediates, slices and words of texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

# The white space of the contract's words `[^\\x20\\x09-\\x0D]+`.
WHITE = " \t\n\x0b\f\r"

# At most so many bytes of text are worked on at a time, or one text.
SLICE_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_examlens_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="examlens-code-"), "examlens_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._examlens_shipped = True


def map_batches(df: DataFrame, function, schema: StructType) -> DataFrame:
    """`mapInArrow` with this package's modules at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def whole_row(docs: DataFrame, *names: str) -> Column:
    """The columns, or those named, as one struct; names may hold dots or backticks."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names or docs.columns])


def read_table(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again.

    Cuts the lineage at files that survive the loss of executors; later readers take
    only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in _recorded:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Who wants to know what is written, see `recorded`.
_recorded: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that gets the folder of every table written meanwhile."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded[:] = [p for p in _recorded if p is not paths]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for folder in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with at most `limit` bytes each, or one row."""
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def strings(column: pa.Array) -> pa.Array:
    """A text column without nulls: null counts as empty."""
    return pc.fill_null(column, pa.scalar("", column.type))


def batches_by_size(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` bytes of `text`, or one row."""
    for batch in batches:
        for start, stop in slices(batch.column(text), limit):
            yield batch.slice(start, stop - start)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, each different word once.

    `rows` has the bounds of each text in `codes`, `codes` the index of each word in
    `distinct`.
    """

    def __init__(self, texts: pa.Array):
        # Whitespace runs give no empty word but at the ends of a text; those go below.
        parts = pc.ascii_split_whitespace(strings(texts))
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        encoded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes = np.asarray(encoded.indices)
        full = np.asarray(pc.binary_length(encoded.dictionary)) > 0
        held = full[codes] if len(codes) else np.zeros(0, bool)
        before = np.concatenate(([0], np.cumsum(held)))
        self.rows = before[bounds - bounds[0]]
        self.codes = codes[held]
        self.distinct = encoded.dictionary

    def __len__(self) -> int:
        return len(self.rows) - 1

    def of(self, row: int) -> np.ndarray:
        return self.codes[self.rows[row] : self.rows[row + 1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)
