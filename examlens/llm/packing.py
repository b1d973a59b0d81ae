"""Packing token streams into fixed windows: concatenate and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import batches_by_size, map_batches, written
from .tokenizing import WordIds

WINDOW = 4096


def tokenized(
    docs: DataFrame, tokenizer_file: str, end_id: int, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """First pass: the ids of every text and `end_id`, with their place in the partition.

    Written once to the shared folder, so a lost executor repeats its tasks only and the
    places cannot change between the passes. Columns: the id, `part`, `part_start` (ids
    before it in its partition), `n_ids`, `ids` (little-endian unsigned 32 bit).
    """
    schema = StructType(
        [
            StructField(id_column, docs.schema[id_column].dataType),
            StructField("part", IntegerType()),
            StructField("part_start", LongType()),
            StructField("n_ids", LongType()),
            StructField("ids", BinaryType()),
        ]
    )
    end = np.array([end_id], dtype="<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = WordIds(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches_by_size(batches, text_column):
            ids, bounds = encoder(batch.column(text_column))
            stream = np.insert(ids, bounds[1:], end).astype("<u4", copy=False)
            bounds = bounds + np.arange(len(bounds))
            offsets = pa.py_buffer((bounds * 4).astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column),
                    pa.array(np.full(batch.num_rows, part, dtype=np.int32)),
                    pa.array(total + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    binary,
                ],
                names=schema.names,
            )
            total += int(bounds[-1])

    return written(map_batches(docs.select(id_column, text_column), encode, schema), "tokenized")


def part_starts(tokens: DataFrame) -> DataFrame:
    """Second pass over the totals: ids before each partition.

    One row per partition of the first pass, so the window over all of them handles as
    many rows as there were tasks, whatever the number of documents.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.selectExpr(
        "part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS stream_start"
    )


def cut(tokens: DataFrame, window: int = WINDOW, *, id_column: str = "doc_id") -> DataFrame:
    """The pieces of every document in windows of the concatenated stream, with their ids.

    A document that spans windows gives one piece in each; no rows move, only the
    partitions' starts (one row per task) are broadcast.
    """
    placed = tokens.join(F.broadcast(part_starts(tokens)), "part").select(
        id_column, "n_ids", "ids", (F.col("stream_start") + F.col("part_start")).alias("stream_start")
    )
    schema = StructType(
        [
            StructField(id_column, tokens.schema[id_column].dataType),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("doc_tokens", LongType()),
            StructField("sequence_id", LongType()),
            StructField("offset", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, "ids"):
            first = np.asarray(batch.column("stream_start"), dtype=np.int64)
            count = np.asarray(batch.column("n_ids"), dtype=np.int64)
            windows = (first + count - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(first)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = first[row] // window + nth
            start = np.maximum(sequence * window, first[row]) - first[row]
            stop = np.minimum((sequence + 1) * window, first[row] + count[row]) - first[row]
            # The pieces of a document lie one after the other, so the buffer stays as it is.
            ids = batch.column("ids")
            lengths = pa.py_buffer(np.concatenate(([0], np.cumsum((stop - start) * 4))).astype(np.int32))
            data = pa.py_buffer(b"".join(x.as_buffer() for x in ids)) if len(ids) else pa.py_buffer(b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column).take(pa.array(row)),
                    pa.array(start),
                    pa.array(stop - start),
                    pa.array(count[row]),
                    pa.array(sequence),
                    pa.array(first[row] + start - sequence * window),
                    pa.Array.from_buffers(pa.binary(), len(row), [None, lengths, data]),
                ],
                names=schema.names,
            )

    return map_batches(placed, pieces, schema)


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    end_id: int,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of `window` ids; only the last one is shorter.

    One row per piece: the id, `start` (ids of the document before it), `length`,
    `doc_tokens` (with the end id), `sequence_id`, `offset` and the `ids` themselves.
    The documents follow in the order of the input's partitions. A null text is empty
    and gives the end id alone; null and repeated ids are documents like any other; an
    empty table gives no piece; other columns are not read.
    """
    tokens = tokenized(docs, tokenizer_file, end_id, id_column=id_column, text_column=text_column)
    return cut(tokens, window, id_column=id_column)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned CRC-32 of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
